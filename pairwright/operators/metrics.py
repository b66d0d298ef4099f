"""Classification metrics in closed form over counts; ranking metrics over tie groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running, same, tie_ranks


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    n = tp + fp + fn + tn
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    f0 = ratio(2 * tn, 2 * tn + fp + fn)
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    d = lambda c: c.cast("double")
    spread = d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn)
    return {
        "precision": ratio(tp, tp + fp),
        "recall": recall,
        "f1": f1,
        "accuracy": ratio(tp + tn, n),
        "balanced_accuracy": (recall + specificity) / 2,
        "macro_f1": (f1 + f0) / 2,
        "mcc": F.when(spread == 0, 0.0).otherwise((d(tp) * d(tn) - d(fp) * d(fn)) / F.sqrt(spread)),
    }


def confusion(df: DataFrame, keys: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn by keys."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    return df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def with_metrics(counts: DataFrame, names=None, digits: int | None = None) -> DataFrame:
    cols = metric_columns(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return counts.withColumns({k: F.round(v, digits) if digits is not None else v for k, v in cols.items() if names is None or k in names})


def roc_auc(df: DataFrame, keys: list[str], label: str = "label", score: str = "score", single=None) -> DataFrame:
    """Area under the ROC curve by keys: the Mann-Whitney statistic over tie groups.

    Rows are summed by score first, and running sums do not need a group in one task. With one class
    the value is `single`: null, or NaN where the caller wants it so.
    """
    ties = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    ties = running(ties, keys, [F.col(score)], {"upto": "n"})
    ties = ties.withColumn("won", F.col("p") * (F.col("upto") - F.col("n") / 2.0))
    out = ties.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    value = F.when((F.col("p") == 0) | (F.col("n") == 0), F.lit(single).cast("double")).otherwise(F.col("won") / (F.col("p") * F.col("n")))
    return out.select(*keys, value.alias("auc"))


def average_precision(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Sum of precision times the gain of recall over distinct scores, highest first."""
    ties = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("m"))
    ties = running(ties, keys, [F.desc(score)], {"tp": "p", "seen": "m"})
    out = ties.groupBy(*keys).agg(F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("s"), F.sum("p").alias("p"))
    return out.select(*keys, F.when(F.col("p") == 0, F.lit(None).cast("double")).otherwise(F.col("s") / F.col("p")).alias("average_precision"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Rank correlation by keys, ties sharing their mean rank; NaN with fewer than `least` rows or without variation.

    Rows are counted by (x, y), and ranks attached to the counts. Rows without x or y take no part.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("c"))
    ranked = cells
    for side in ("_x", "_y"):
        upto = tie_ranks(cells, keys, side, F.col("c")).select(*keys, side, F.col("rank").alias(f"r{side}"))
        ranked = same(ranked, upto, [*keys, side])
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    middle = ranked.groupBy(*keys).agg(((F.sum("c") + 1) / 2.0).alias("mid"))
    d = same(ranked, middle, keys).withColumns({"dx": F.col("r_x") - F.col("mid"), "dy": F.col("r_y") - F.col("mid")})
    s = d.groupBy(*keys).agg(F.sum(F.col("c") * F.col("dx") * F.col("dy")).alias("xy"), F.sum(F.col("c") * F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col("c") * F.col("dy") * F.col("dy")).alias("yy"))
    corr = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx")) / F.sqrt(F.col("yy")))
    out = same(n, s, keys, "left")
    return out.select(*keys, "n", F.when(F.col("n") < least, F.lit(float("nan"))).otherwise(F.coalesce(corr, F.lit(float("nan")))).alias("spearman"))


def gini(values: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Gini coefficient by keys, from counts of equal values."""
    c = values.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("c"))
    c = running(c, keys, [F.col(col)], {"upto": "c"})
    before = F.col("upto") - F.col("c")
    # the ranks of c equal values after `before` smaller ones sum to c * before + c (c + 1) / 2
    c = c.withColumn("ranked", F.col(col) * (F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2.0))
    s = c.groupBy(*keys).agg(F.sum("ranked").alias("r"), F.sum(F.col(col) * F.col("c")).alias("t"), F.sum("c").alias("n"))
    return s.select(*keys, F.when(F.col("t") == 0, 0.0).otherwise(2 * F.col("r") / (F.col("n") * F.col("t")) - (F.col("n") + 1.0) / F.col("n")).alias("gini"))
