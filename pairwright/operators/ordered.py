"""Ranks, running sums, quantiles and draws within groups, none of which has to fit into a task.

Running values come from one range partitioning by (keys, order): each part sums its own rows, and
what a group has in earlier parts is added from a table with a row for each part and group. A draw of
the k rows of least hash finds the hash at which a stratum's quota is full by counts of ever longer
hash prefixes. Quantiles fix the bits of every order statistic, 16 at a time, from counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..sources.storage import _ranged, stored

#: Rows up to which a table that is joined to every row is sent to all tasks.
SMALL = 100_000
#: Rows or distinct values of all groups together up to which a task may hold a group of them.
ONE_TASK = 1_000_000
#: Hex digits of a hash that a draw counts at a time, and how often, before it ranks what is left.
DIGITS, LEVELS = 3, 2


def sized(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df (a written table), marked for broadcast if it has no more than `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal; the keys are a's."""
    other = b.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return a.join(other, on, how).drop(*[f"_same_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column | str]) -> DataFrame:
    """df with the sums up to and with each row of its group, in a total order of the group's rows."""
    parts = _ranged(df, [*map(F.col, keys), *order])
    each = parts.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_part")
    base = each.select("_part", *keys, F.row_number().over(before).alias("_nth"), *[(F.sum(f"_{k}").over(before) - F.col(f"_{k}")).alias(f"_{k}") for k in sums])
    base = base.where("_nth > 1").drop("_nth")  # groups that go on from an earlier part: one a part at most
    local = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = same(parts.withColumns({k: F.sum(c).over(local) for k, c in sums.items()}), F.broadcast(base), ["_part", *keys], "left")
    return out.withColumns({k: F.col(k) + F.coalesce(f"_{k}", F.lit(0)) for k in sums}).drop("_part", *[f"_{k}" for k in sums])


def least_after(df: DataFrame, keys: list[str], order: list[Column], col: str, name: str) -> DataFrame:
    """df with the least value of each row and those after it in its group, in a total order of the group's rows."""
    parts = _ranged(df, [*map(F.col, keys), *order])
    later = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    each = parts.groupBy("_part", *keys).agg(F.min(col).alias("_least"))
    base = each.select("_part", *keys, F.min("_least").over(later).alias("_later")).where("_later is not null")
    # from the last row back, as a frame that only ends grows by a row; one that only begins is read again for every row
    local = Window.partitionBy("_part", *keys).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = same(parts.withColumn(name, F.min(col).over(local)), F.broadcast(base), ["_part", *keys], "left")
    return out.withColumn(name, F.least(name, "_later")).drop("_part", "_later")


def numbered_by(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """df with row numbers from 1 within each group, in a total order of its rows."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def tie_ranks(df: DataFrame, keys: list[str], col: str, weight: Column) -> DataFrame:
    """keys, col, n, rank: the rows of each value (a row stands for `weight` of them) and the mean of their ranks from 1."""
    ties = df.groupBy(*keys, col).agg(F.sum(weight).alias("n"))
    upto = running(ties, keys, [F.col(col)], {"_to": "n"})
    return upto.select(*keys, col, "n", (F.col("_to") - (F.col("n") - 1) / 2.0).alias("rank"))


def draw(df: DataFrame, strata: list[str], hashed: Column, ids: list[str], quota: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Of each stratum the rows with the least hash: as many as quota(strata, _w) says; strata without a quota give none.

    hashed: a hex string; ids break ties of it. Up to `one_task` rows are ranked at once, to the same end.
    """
    if not strata:
        raise ValueError("a draw needs strata; top_k draws from all rows")
    cols = df.columns
    now = stored(df.withColumn("_h", hashed), "draw")
    levels = LEVELS if now.limit(one_task + 1).count() > one_task else 0
    now = same(now, sized(stored(quota.select(*strata, "_w"), "quota")), strata)
    taken = None
    for level in range(levels):
        bin_ = F.substring("_h", 1 + DIGITS * level, DIGITS)
        count = now.groupBy(*strata, bin_.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.first("_w").alias("_w"))
        upto = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))  # 4,096 bins
        cut = count.withColumn("_u", upto).groupBy(*strata).agg(F.min(F.when(F.col("_u") > F.col("_w"), F.struct("_b", (F.col("_w") - F.col("_u") + F.col("_n")).alias("r")))).alias("_c"))
        now = same(now, sized(stored(cut, "cuts")), strata)
        below = now.where(F.col("_c").isNull() | (bin_ < F.col("_c._b"))).select(*cols)
        taken = below if taken is None else taken.unionByName(below)
        now = now.where(bin_ == F.col("_c._b")).withColumn("_w", F.col("_c.r")).drop("_c")
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_h", *ids))  # after two levels a 16-millionth of a stratum
    rest = now.withColumn("_k", rank).where("_k <= _w").select(*cols)
    return rest if taken is None else taken.unionByName(rest)


@F.pandas_udf(LongType())
def _bits(x: pd.Series) -> pd.Series:
    """Whole numbers in the order of the doubles."""
    b = (x.to_numpy("float64") + 0.0).view(np.int64)
    return pd.Series(np.where(b < 0, ~b ^ np.int64(-(2**63)), b))


@F.pandas_udf(DoubleType())
def _value(x: pd.Series) -> pd.Series:
    b = x.to_numpy("int64")
    return pd.Series(np.where(b < 0, ~(b ^ np.int64(-(2**63))), b).view(np.float64))


def order_statistics(counts: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """keys, r, v: the value of each rank r from 0. counts: keys, v, w (rows of value v); ranks: keys, r, all below the totals.

    Four passes over the counts fix 16 bits of all values at a time; a pass keeps counts of the bins that hold a rank.
    """
    rows = counts.select(*keys, _bits("v").alias("_v"), "w")
    rows = stored(rows.groupBy(*keys, "_v").agg(F.sum("w").alias("w")), "values")
    state = stored(ranks.select(*keys, "r", F.lit(0).cast("long").alias("_p"), F.col("r").alias("_rest")), "ranks")
    few = state.limit(SMALL + 1).count() <= SMALL
    for shift in (48, 32, 16, 0):
        upper = F.shiftright("_v", shift + 16) if shift < 48 else F.lit(0).cast("long")
        live = rows.withColumn("_p", upper)
        if shift < 48:
            wanted = state.select(*keys, "_p").distinct()
            live = same(live, F.broadcast(wanted) if few else wanted, [*keys, "_p"], "left_semi")
        bins = live.groupBy(*keys, "_p", F.shiftright("_v", shift).alias("_q")).agg(F.sum("w").alias("w"))
        group = Window.partitionBy(*keys, "_p")  # 65,536 bins and the ranks asked for
        start = F.sum("w").over(group.orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
        marks = bins.select(*keys, "_p", "_q", start.alias("_at"), F.lit(None).cast("long").alias("r"), F.lit(None).cast("long").alias("_rest"))
        asked = state.select(*keys, "_p", F.lit(None).cast("long").alias("_q"), F.col("_rest").alias("_at"), "r", "_rest")
        seen = group.orderBy("_at", F.col("r").isNotNull(), "_q").rowsBetween(Window.unboundedPreceding, 0)
        both = marks.unionByName(asked).withColumns({"_bin": F.last("_q", True).over(seen), "_from": F.last(F.when(F.col("r").isNull(), F.col("_at")), True).over(seen)})
        state = stored(both.where("r is not null").select(*keys, "r", F.col("_bin").alias("_p"), (F.col("_rest") - F.col("_from")).alias("_rest")), "ranks")
    return state.select(*keys, "r", _value("_p").alias("v"))


def quantiles(df: DataFrame, keys: list[str], col: str, qs, weight: Column | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """keys, q: exact quantiles in the order of qs, interpolated between neighbouring rows; nulls are left out.

    As F.percentile, which serves up to `one_task` distinct values, without its map of all values of a group. With weight a
    row stands for so many rows.
    """
    qs = [float(q) for q in qs]
    one = F.lit(1).cast("long") if weight is None else weight.cast("long")
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("v")).agg(F.sum(one).alias("w"))
    counts = stored(counts.where("w > 0"), "counts")
    if counts.limit(one_task + 1).count() <= one_task:
        return counts.groupBy(*keys).agg(F.percentile("v", qs, F.col("w")).alias("q"))
    total = stored(counts.groupBy(*keys).agg(F.sum("w").alias("_n")), "totals")
    at = total.select(*keys, "_n", F.posexplode(F.array(*map(F.lit, qs))).alias("_i", "_f")).withColumn("_at", F.col("_f") * (F.col("_n") - 1))
    at = at.withColumns({"_lo": F.floor("_at"), "_hi": F.ceil("_at")})
    found = order_statistics(counts, keys, at.select(*keys, F.explode(F.array("_lo", "_hi")).alias("r")).distinct())
    low, high = found.select(*keys, F.col("r").alias("_lo"), F.col("v").alias("_a")), found.select(*keys, F.col("r").alias("_hi"), F.col("v").alias("_b"))
    both = same(same(at, low, [*keys, "_lo"]), high, [*keys, "_hi"])
    between = (F.col("_hi") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_lo")) * F.col("_b")
    each = both.select(*keys, F.struct("_i", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("x")).alias("_x"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_x")).select(*keys, F.col("_x.x").alias("q"))
