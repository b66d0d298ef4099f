"""Bootstrap and interval estimates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running
from .sampling import hash_fraction

# Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom.
T95 = (12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272)


def t_quantile(n: Column) -> Column:
    """For n values; the normal quantile beyond the table."""
    table = F.array(*map(F.lit, T95))
    return F.when(n < 2, F.lit(None).cast("double")).when(n - 1 > len(T95), 1.959964).otherwise(F.element_at(table, F.greatest(F.lit(1), F.least(n - 1, F.lit(len(T95)))).cast("int")))


def seed_summary(runs: DataFrame, keys: list[str], value: str, least: int = 2) -> DataFrame:
    """Mean, sample deviation and 95 % interval by keys; groups of fewer runs are left out."""
    g = runs.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).where(F.col("n") >= least)
    half = t_quantile(F.col("n")) * F.col("sd") / F.sqrt("n")
    return g.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def finite_mean_var(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample variance of the finite values; one value has variance 0."""
    ok = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return df.groupBy(*keys).agg(F.avg(ok).alias("mean"), F.when(F.count(ok) == 1, 0.0).otherwise(F.var_samp(ok)).alias("variance"))


#: Chances of at most 0, 1, 2, ... draws of a unit in a replicate.
POISSON = tuple(float(x) for x in np.cumsum([np.exp(-1) / np.prod(range(1, k + 1) or [1]) for k in range(12)]))


def poisson_weight(replicate: Column, unit: Column, seed: int) -> Column:
    """How often a unit is drawn in a replicate: Poisson(1) by SHA-256, the same in any partitioning and any engine."""
    u = hash_fraction(F.concat_ws("/", F.lit(str(seed)), replicate.cast("string"), unit.cast("string")))
    return F.aggregate(F.array(*map(F.lit, POISSON)), F.lit(0), lambda n, p: n + (u >= p).cast("int"))


def paired_bootstrap(pairs: DataFrame, a: str, b: str, unit: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Difference of mean correctness of two methods, and its 2.5 and 97.5 percentiles.

    Units are summed before replicates multiply rows, so the cost is units times replicates.
    """
    u = pairs.groupBy(unit).agg(F.sum(F.col(a) - F.col(b)).alias("d"), F.count(F.lit(1)).alias("n"))
    r = u.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", poisson_weight(F.col("r"), F.col(unit), seed))
    each = r.groupBy("r").agg((F.sum(F.col("w") * F.col("d")) / F.sum(F.col("w") * F.col("n"))).alias("diff"))
    point = u.agg((F.sum("d") / F.sum("n")).alias("difference"), F.sum("n").alias("pairs"))
    q = each.agg(F.percentile("diff", [0.025, 0.975]).alias("q"), F.count("diff").alias("replicates"))
    return point.crossJoin(F.broadcast(q)).select("pairs", "difference", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "replicates")


def cluster_bootstrap(predictions: DataFrame, replicates: int = 100, seed: int = 7, least_seeds: int = 3, least_valid: float = 0.9) -> DataFrame:
    """Accuracy difference of methods a and b with problems and seeds drawn again: a pair weighs the product
    of its problems' draws, once if both are one problem, and of its seed's draws.

    predictions(left_problem, right_problem, seed, correct_a, correct_b). Fewer shared seeds, or too few replicates that have
    any weight, are an error.
    """
    t = predictions.groupBy("left_problem", "right_problem", "seed").agg(F.sum(F.col("correct_a") - F.col("correct_b")).alias("d"), F.count(F.lit(1)).alias("n"))
    seeds = t.agg(F.count_distinct("seed").alias("seeds"))
    each = t.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    p, q = poisson_weight(F.col("r"), F.col("left_problem"), seed), poisson_weight(F.col("r"), F.col("right_problem"), seed)
    w = F.when(F.col("left_problem") == F.col("right_problem"), p).otherwise(p * q) * poisson_weight(F.col("r"), F.concat(F.lit("seed/"), F.col("seed").cast("string")), seed)
    g = each.withColumn("w", w).groupBy("r").agg(F.sum(F.col("w") * F.col("d")).alias("s"), F.sum(F.col("w") * F.col("n")).alias("m"))
    ok = g.where("m > 0").select((F.col("s") / F.col("m")).alias("x"))
    out = ok.agg(F.count(F.lit(1)).alias("valid"), F.avg("x").alias("mean"), F.get(F.percentile("x", [0.025, 0.975]), F.lit(0)).alias("low"), F.get(F.percentile("x", [0.025, 0.975]), F.lit(1)).alias("high"))
    fine = F.when(F.col("seeds") < least_seeds, F.raise_error(F.lit(f"fewer than {least_seeds} shared seeds"))).when(F.col("valid") < least_valid * replicates, F.raise_error(F.lit("too few valid replicates"))).otherwise(F.lit(True))
    return out.crossJoin(F.broadcast(seeds)).where(fine).select("seeds", "valid", "mean", "low", "high")


def auc_difference(scores: DataFrame, a: str, b: str, replicates: int = 50, seed: int = 7) -> DataFrame:
    """Difference of the areas under the curves of two scores of the same rows (id, label), and its 2.5 and 97.5 percentiles over
    replicates in which each label's rows are drawn again. Scores of a row share its draws."""
    both = scores.select("id", "label", F.explode(F.create_map(F.lit("a"), F.col(a).cast("double"), F.lit("b"), F.col(b).cast("double"))).alias("side", "score"))
    r = both.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    r = r.withColumn("w", F.when(F.col("r") == 0, 1).otherwise(poisson_weight(F.col("r"), F.col("id").cast("string"), seed)))
    by = r.groupBy("side", "r", "score").agg(F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") != 1, F.col("w")).otherwise(0)).alias("q"))
    by = running(by, ["side", "r"], [F.col("score")], {"upto": "q"})
    auc = by.withColumn("won", F.col("p") * (F.col("upto") - F.col("q") / 2.0)).groupBy("side", "r").agg((F.sum("won") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))
    d = auc.groupBy("r").agg((F.max(F.when(F.col("side") == "a", F.col("auc"))) - F.max(F.when(F.col("side") == "b", F.col("auc")))).alias("d"))
    draws = F.when(F.col("r") > 0, F.col("d"))
    return d.agg(F.max(F.when(F.col("r") == 0, F.col("d"))).alias("difference"), F.count(draws).alias("valid"), F.percentile(draws, 0.025).alias("low"), F.percentile(draws, 0.975).alias("high"))


def auc_bootstrap(scores: DataFrame, key: str, replicates: int = 50, seed: int = 7) -> DataFrame:
    """Area under the ROC curve of resampled rows (id, label, score), by key: mean and percentiles. Every row has draws of its own."""
    r = scores.select(key, "id", "label", "score").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson_weight(F.col("r"), F.col("id").cast("string"), seed)
    by = r.withColumn("w", w).groupBy(key, "r", "score").agg(F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") != 1, F.col("w")).otherwise(0)).alias("q"))
    by = running(by, [key, "r"], [F.col("score")], {"upto": "q"})
    a = by.withColumn("won", F.col("p") * (F.col("upto") - F.col("q") / 2.0)).groupBy(key, "r").agg((F.sum("won") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))
    return a.groupBy(key).agg(F.count("auc").alias("valid"), F.avg("auc").alias("mean"), F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))
