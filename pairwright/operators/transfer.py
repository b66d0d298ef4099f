"""Transfer plans: what to train on and what to hold out, over the languages at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(a: Column, b: Column) -> Column:
    """One name for a pair of languages in either order."""
    return F.when(a == b, a).otherwise(F.concat_ws("-", F.least(a, b), F.greatest(a, b)))


def paths(languages: DataFrame, hops: int) -> DataFrame:
    """path: all sequences of hops + 1 distinct languages (joins of a table of a few rows)."""
    out = languages.select(F.array("language").alias("path"))
    for _ in range(hops):
        nxt = languages.select(F.col("language").alias("_l"))
        out = out.join(F.broadcast(nxt), ~F.array_contains("path", F.col("_l"))).select(F.concat("path", F.array("_l")).alias("path"))
    return out


def bridges(languages: DataFrame, hops: int) -> DataFrame:
    """kind, path, train, test: training reaches the target only along the path's hops; every
    subset of the languages between may be reinforced by its own bucket."""
    p = paths(languages, hops).withColumnRenamed("path", "_p").withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** (hops - 1) - 1))))
    step = F.transform(F.sequence(F.lit(1), F.lit(hops)), lambda i: bucket(F.get("_p", i - 1), F.get("_p", i)))
    own = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(2 ** (i - 1)) > 0, F.get("_p", F.lit(i))) for i in range(1, hops)])) if hops > 1 else F.array().cast("array<string>")
    train = F.array_distinct(F.concat(F.array(F.get("_p", F.lit(0))), step, own))
    return p.select(F.lit(f"bridge{hops}").alias("kind"), F.array_join("_p", ">").alias("path"), F.col("mask").alias("reinforced"), F.array_join(train, ",").alias("train"), F.element_at("_p", -1).alias("test"))


def plan(languages: DataFrame) -> DataFrame:
    """Controls within a language and across two, and bridges of one to three hops."""
    one = languages.select(F.lit("within").alias("kind"), F.col("language").alias("path"), F.lit(0).alias("reinforced"), F.col("language").alias("train"), F.col("language").alias("test"))
    a, b = languages.select(F.col("language").alias("a")), languages.select(F.col("language").alias("b"))
    two = a.join(F.broadcast(b), F.col("a") < F.col("b")).select(F.lit("cross").alias("kind"), F.concat_ws(">", "a", "b").alias("path"), F.lit(0).alias("reinforced"), F.concat_ws(",", "a", "b").alias("train"), bucket(F.col("a"), F.col("b")).alias("test"))
    out = one.unionByName(two)
    for hops in (1, 2, 3):
        out = out.unionByName(bridges(languages, hops))
    return out
