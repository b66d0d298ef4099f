"""Tables of program fragments derived from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codes(spark, sf_dir) -> DataFrame:
    """code_id, code, language, problem_id."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("code_id"), F.col("text").alias("code"), F.col("lang").alias("language"), F.col("source").alias("problem_id"), "n_chars")


def spectra(spark, sf_dir) -> DataFrame:
    """code_id, layer, label, ev: ascending non-negative values: all of a vector's, and up to 48 of them again with one added, so
    that spectra differ in length."""
    size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    ev = F.sort_array(F.concat(size, F.transform(F.slice(size, F.lit(1), (F.col("vec_id") % 49).cast("int")), lambda x: x + 1)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("code_id"), (F.col("vec_id") % 4).cast("int").alias("layer"), "label", ev.alias("ev"))


def pairs(spark, sf_dir) -> DataFrame:
    """left_id, right_id, label, layer1, layer2, ev1, ev2 of fragments at most SPAN ids apart.

    The range condition is an equi-join on blocks of SPAN ids: a fragment goes to its own block and the next.
    """
    s = spectra(spark, sf_dir)
    block = lambda c: F.floor(F.col(c) / SPAN)
    a = s.select(F.col("code_id").alias("left_id"), F.col("layer").alias("layer1"), F.col("label").alias("l1"), F.col("ev").alias("ev1"), F.explode(F.array(block("code_id"), block("code_id") + 1)).alias("_block"))
    b = s.select(F.col("code_id").alias("right_id"), F.col("layer").alias("layer2"), F.col("label").alias("l2"), F.col("ev").alias("ev2"), block("code_id").alias("_block"))
    both = a.join(b, "_block").where((F.col("right_id") > F.col("left_id")) & (F.col("right_id") <= F.col("left_id") + SPAN))
    return both.select("left_id", "right_id", (F.col("l1") == F.col("l2")).cast("int").alias("label"), "layer1", "layer2", "ev1", "ev2")


def scored(spark, sf_dir) -> DataFrame:
    """doc_id, lang, source, label, score: labelled rows with a score of six decimals."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    score = F.round((F.col("n_chars") % 997) / 997.0, 4)
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("label"), score.alias("score"))


def endpoints(spark, sf_dir) -> DataFrame:
    """edge_id, left_id, right_id, label, kind, split: a pair graph with repeated pairs."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("edge_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("left_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("right_id"),
        (F.col("l_quantity") > 25).cast("int").alias("label"),
        F.col("l_returnflag").alias("kind"),
        F.when(F.col("l_orderkey") % 10 < 7, "train").when(F.col("l_orderkey") % 10 < 8, "valid").otherwise("test").alias("split"),
    )


#: The same tables in the SQL of the oracle.
SQL_SPECTRA = "spectra AS (SELECT vec_id AS code_id, (vec_id % 4)::INTEGER AS layer, label, list_sort(list_concat(list_transform(embedding, lambda x: abs(x::DOUBLE)), list_transform(embedding[1:(vec_id % 49)], lambda x: abs(x::DOUBLE) + 1))) AS ev FROM embeddings)"
SQL_PAIRS = SQL_SPECTRA + ", pairs AS (SELECT a.code_id AS left_id, b.code_id AS right_id, (a.label = b.label)::INTEGER AS label, a.layer AS layer1, b.layer AS layer2, a.ev AS ev1, b.ev AS ev2 FROM spectra a JOIN spectra b ON b.code_id > a.code_id AND b.code_id - a.code_id <= 20)"
SQL_SCORED = "scored AS (SELECT l.doc_id, d.lang, d.source, l.quality AS label, round((d.n_chars % 997) / 997.0::DOUBLE, 4) AS score FROM labels l JOIN documents d USING (doc_id))"
SQL_ENDPOINTS = "endpoints AS (SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS edge_id, 'p' || l_partkey::VARCHAR AS left_id, 's' || l_suppkey::VARCHAR AS right_id, (l_quantity > 25)::INTEGER AS label, l_returnflag AS kind, CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split FROM lineitem)"
