"""Threshold selection: ten policies over one sweep.

Scores are summed by value, candidate thresholds are laid between them in one ordered pass per
group, and the best candidate is an argmax over a struct. Policies differ in candidates,
objective and tie-break, and are deliberately not unified.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.storage import numbered, stored
from .metrics import metric_columns, roc_auc
from .ordered import numbered_by, quantiles, running, same


def linspace(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n)]


@dataclass(frozen=True)
class Policy:
    grid: tuple[float, ...] = ()
    quantiles: tuple[float, ...] = ()
    unique: bool = False
    midpoints: bool = False
    above_all: bool = False
    float32: bool = False
    just_below: bool = False
    ranking: dict[str, tuple[str, ...]] = field(default_factory=dict)
    digits: int | None = None
    largest: bool = False


_F1_OR_ACC = {"accuracy": ("accuracy", "f1"), "f1": ("f1", "balanced_accuracy")}
POLICIES: dict[str, Policy] = {
    "exact": Policy(grid=(0.0, 1.0), unique=True, midpoints=True, just_below=True, largest=True),
    "coarse_grid": Policy(grid=tuple(linspace(0.6, 0.95, 15)), ranking={"f1": ("f1",)}),
    "grid": Policy(grid=tuple(linspace(0.01, 0.99, 199)), quantiles=tuple(linspace(0, 1, 301)), ranking=_F1_OR_ACC),
    "grid_float32": Policy(grid=tuple(linspace(0.01, 0.99, 199)), quantiles=tuple(linspace(0, 1, 201)), float32=True, ranking=_F1_OR_ACC),
    "pr_curve_all": Policy(unique=True, above_all=True, digits=12, largest=True, ranking={"accuracy": ("accuracy", "f1"), "f1": ("f1", "accuracy")}),
    "pr_curve": Policy(unique=True, largest=True, ranking={"accuracy": ("accuracy", "f1"), "f1": ("f1", "f1")}),
    "percentiles": Policy(quantiles=tuple(i / 100 for i in range(1, 100)), ranking={"f1": ("f1", "auc", "accuracy")}),
    "sweep": Policy(unique=True, midpoints=True, ranking={m: (m, "auc", "accuracy") for m in ("f1", "accuracy", "precision", "recall")}),
    "quantiles_half": Policy(grid=(0.5,), quantiles=tuple(linspace(0, 1, 301)), ranking={"f1": ("f1", "accuracy")}),
    "four_level": Policy(grid=tuple(linspace(0.01, 0.99, 199)), quantiles=tuple(linspace(0, 1, 201)), ranking={"f1": ("f1", "balanced_accuracy", "macro_f1", "accuracy"), "accuracy": ("accuracy", "f1", "balanced_accuracy", "macro_f1"), "balanced_accuracy": ("balanced_accuracy", "f1", "macro_f1", "accuracy")}),
}


@F.pandas_udf(DoubleType())
def _just_below(t: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(t.to_numpy(dtype="float64"), -np.inf))


@F.pandas_udf(DoubleType())
def _just_above(t: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(t.to_numpy(dtype="float64"), np.inf))


def candidates(ties: DataFrame, keys: list[str], policy: Policy) -> DataFrame:
    """keys, threshold, at: `at` is what scores are compared with. ties(keys, score, p, n) has a row for each score."""
    values = ties.select(*keys, "score")
    out = []
    if policy.grid:
        out.append(ties.select(*keys, F.lit(1).alias("_one")).distinct().select(*keys, F.explode(F.array(*map(F.lit, policy.grid))).alias("threshold")))
    if policy.quantiles:
        q = quantiles(ties, keys, "score", policy.quantiles, F.col("p") + F.col("n"))
        out.append(q.select(*keys, F.explode("q").alias("threshold")))
    if policy.unique:
        out.append(values.select(*keys, F.col("score").alias("threshold")))
    if policy.midpoints:
        k = numbered_by(values, keys, [F.col("score")], "_k")
        after = k.select(*keys, (F.col("_k") - 1).alias("_k"), F.col("score").alias("_next"))
        out.append(same(k, after, [*keys, "_k"]).select(*keys, ((F.col("score") + F.col("_next")) / 2).alias("threshold")))
    if policy.above_all:
        out.append(ties.groupBy(*keys).agg(F.max("score").alias("t")).select(*keys, _just_above("t").alias("threshold")))
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    both = both.distinct()
    return both.withColumn("at", _just_below("threshold") if policy.just_below else F.col("threshold"))


def sweep(scores: DataFrame, keys: list[str], policy: Policy, lower_is_clone: bool = False) -> DataFrame:
    """keys, threshold, tp, fp, fn, tn of every candidate."""
    df = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).select(*keys, "label", "score")
    if policy.float32:
        df = df.withColumn("score", F.col("score").cast("float").cast(DoubleType()))
    # scores are computed once, and counted; all else is laid between the counts
    ties = stored(df.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n")), "ties")
    cand = candidates(ties, keys, policy)
    marks = cand.select(*keys, F.col("at").alias("v"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), "threshold")
    counts = ties.select(*keys, F.col("score").alias("v"), "p", "n", F.lit(None).cast(DoubleType()).alias("threshold"))
    # scores equal to a threshold stand before it in the pass, so they count as reached
    way = F.asc if lower_is_clone else F.desc
    order, both = [way("v"), F.col("threshold").isNotNull()], counts.unionByName(marks)
    run = running(both, keys, [*order, F.col("threshold")], {"tp": "p", "fp": "n"})
    total = ties.groupBy(*keys).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("_neg"))
    run = same(run, total, keys) if keys else run.crossJoin(F.broadcast(total))
    return run.where("threshold is not null").select(*keys, "threshold", "tp", "fp", (F.col("_pos") - F.col("tp")).alias("fn"), (F.col("_neg") - F.col("fp")).alias("tn"))


def best(scores: DataFrame, keys: list[str], policy_name: str, metric: str, lower_is_clone: bool = False) -> DataFrame:
    """keys, threshold, best_value, tp, fp, fn, tn of the chosen candidate."""
    return best_of(sweep(scores, keys, POLICIES[policy_name], lower_is_clone), keys, policy_name, metric)


def best_of(points: DataFrame, keys: list[str], policy_name: str, metric: str) -> DataFrame:
    """The same from the points of a sweep, which serve any number of metrics."""
    policy = POLICIES[policy_name]
    ranking = policy.ranking.get(metric, (metric,))
    cols = metric_columns(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    if "auc" in ranking:
        cols["auc"] = F.lit(0.0)  # the same for every candidate of a group: never decides
    value = lambda m: F.round(cols[m], policy.digits) if policy.digits is not None else cols[m]
    order: list[Column] = [value(m) for m in ranking] + [F.col("threshold") if policy.largest else -F.col("threshold")]
    points = points.withColumn("best_value", cols[ranking[0]])
    row = F.max_by(F.struct("threshold", "best_value", "tp", "fp", "fn", "tn"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("x")
    return points.groupBy(*keys).agg(row).select(*keys, "x.*")


def apply(scores: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """scores with `predicted`; chosen has one row for each key group (or one row)."""
    one = chosen.select(*keys, "threshold")
    joined = scores.join(one, keys) if keys else scores.crossJoin(F.broadcast(one.limit(1)))
    return joined.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))


def balanced_folds(scores: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Every row of the larger class in one fold with as many rows of the other class.

    Rows are ordered by the hash of seed, fold and id: the larger class is cut into chunks of
    the smaller one's size, and each chunk draws its own rows of the smaller class.
    """
    n = scores.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    rank = lambda *parts: F.sha2(F.concat_ws(":", *parts), 256)
    df = scores.crossJoin(F.broadcast(n)).withColumn("anchor", (F.col("label") == F.when(F.col("p") >= F.col("n"), 1).otherwise(0)))
    df = df.withColumn("size", F.greatest(F.lit(1), F.least("p", "n")))
    idc = F.col(id_col).cast("string")
    a = numbered(df.where("anchor"), [rank(F.lit(seed), idc), F.col(id_col)], "_k").withColumn("fold", F.floor((F.col("_k") - 1) / F.col("size"))).drop("_k")
    # the number of folds follows from the two counts, so no table of folds is needed
    most = F.greatest("p", "n")
    b = df.where("not anchor").withColumn("fold", F.explode(F.sequence(F.lit(0), F.ceil(most / F.col("size")) - 1)))
    b = numbered_by(b.withColumn("_h", rank(F.lit(seed), F.col("fold").cast("string"), idc)), ["fold"], [F.col("_h"), F.col(id_col)], "k").drop("_h")
    b = b.where(F.col("k") <= F.least(F.col("size"), most - F.col("fold") * F.col("size"))).drop("k")
    return a.unionByName(b).drop("p", "n", "size", "anchor")


def balanced_evaluation(scores: DataFrame, id_col: str, metric: str = "f1", seed: int = 42) -> DataFrame:
    """Thresholds chosen fold by fold; pooled counts with each fold's own, their mean reported."""
    folds = balanced_folds(scores, id_col, seed)
    chosen = best(folds, ["fold"], "exact", metric)
    pooled = chosen.agg(F.count(F.lit(1)).alias("folds"), F.avg("threshold").alias("threshold"), F.avg("best_value").alias("mean_value"), F.coalesce(F.var_samp("best_value"), F.lit(0.0)).alias("var_value"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return pooled.withColumns({m: c for m, c in metric_columns(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))).items() if m in ("accuracy", "f1")})


def selection_metric(scores: DataFrame, keys: list[str], declared: str | None = None) -> DataFrame:
    """Accuracy for exactly balanced groups, else F1, unless declared."""
    c = scores.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    return c.select(*keys, (F.lit(declared) if declared else F.when(F.col("p") == F.col("n"), "accuracy").otherwise("f1")).alias("metric"))


def auc_of(scores: DataFrame, keys: list[str], lower_is_clone: bool = False) -> DataFrame:
    return roc_auc(scores.withColumn("score", -F.col("score")) if lower_is_clone else scores, keys)
