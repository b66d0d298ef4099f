"""Joins with checks, deduplication with a stated order, merges and small window queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.storage import stored
from .ordered import least_after, quantiles, running, same

#: Rows of the tables of a lookup that a task sorts.
PART = 2_000_000


def attach(pairs: DataFrame, codes: DataFrame, column: str, key: str = "code_id", strict: bool = True) -> DataFrame:
    """An attribute of both ends of a pair; a missing end is an error if strict."""
    out = pairs
    for side in ("left", "right"):
        c = codes.select(F.col(key).alias(f"{side}_id"), F.col(column).alias(f"{side}_{column}"), F.lit(1).alias("_f"))
        out = out.join(c, f"{side}_id", "left")
        if strict:
            out = out.where(F.when(F.col("_f") == 1, True).otherwise(F.raise_error(F.concat(F.lit("no such code: "), F.col(f"{side}_id").cast("string")))))
        out = out.drop("_f")
    return out


def both_ends(pairs: DataFrame, ids: DataFrame, key: str = "code_id") -> DataFrame:
    """Pairs whose ends are both among the ids."""
    one = ids.select(key).distinct()
    return pairs.join(one.withColumnRenamed(key, "left_id"), "left_id", "left_semi").join(one.withColumnRenamed(key, "right_id"), "right_id", "left_semi")


def informative(spectrum: Column) -> Column:
    """Not empty, finite throughout, and some value beyond 1e-10."""
    finite = F.forall(spectrum, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(spectrum) > 0) & finite & F.exists(spectrum, lambda x: F.abs(x) > 1e-10), F.lit(False))


def informative_pairs(pairs: DataFrame, a: str = "ev1", b: str = "ev2") -> DataFrame:
    """Pairs with informative spectra on both sides; none if only one class would be left."""
    p = pairs.where(informative(F.col(a)) & informative(F.col(b)))
    n = p.agg(F.count_distinct("label").alias("_n"))
    return p.crossJoin(F.broadcast(n)).where("_n = 2").drop("_n")


def common_support(views: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that stand in every one of the views."""
    out = None
    for name, df in views.items():
        v = df.select(key, F.lit(name).alias("_v"))
        out = v if out is None else out.unionByName(v)
    return out.groupBy(key).agg(F.count_distinct("_v").alias("_n")).where(F.col("_n") == len(views)).select(key)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of two tables in which the key is unique, or an error."""
    for name, df in (("left", left), ("right", right)):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique on the {name}")
    return left.join(right, key, "left")


def same_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    x, y = a.select(*columns), b.select(*columns)
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count()


def unknown_pairs(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates that are not known in either direction."""
    u = lambda d: d.withColumn("_a", F.least("left_id", "right_id")).withColumn("_b", F.greatest("left_id", "right_id"))
    return u(candidates).join(u(known).select("_a", "_b").distinct(), ["_a", "_b"], "left_anti").drop("_a", "_b")


def curated_negatives(judged: DataFrame, positives: DataFrame, codes: DataFrame, kept: DataFrame) -> DataFrame:
    """left_id, right_id, reason of judged negatives that are not known positives: accessor (either side), both_short,
    other_filters (an end is not among the kept codes), or kept. codes(code_id, accessor, short)."""
    n = unknown_pairs(judged.select("left_id", "right_id"), positives.select("left_id", "right_id"))
    info = codes.join(kept.select("code_id").distinct().withColumn("k", F.lit(True)), "code_id", "left")
    for side in ("left", "right"):
        n = n.join(info.select(F.col("code_id").alias(f"{side}_id"), *[F.coalesce(c, F.lit(False)).alias(f"_{c}_{side}") for c in ("accessor", "short", "k")]), f"{side}_id", "left")
    either = lambda c, f: f(F.coalesce(f"_{c}_left", F.lit(False)), F.coalesce(f"_{c}_right", F.lit(False)))
    any_, all_ = (lambda a, b: a | b), (lambda a, b: a & b)
    reason = F.when(either("accessor", any_), "accessor").when(either("short", all_), "both_short").when(~either("k", all_), "other_filters").otherwise("kept")
    return n.select("left_id", "right_id", reason.alias("reason"))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def ordered_merge(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union of variants; of equal keys the row of the earliest variant."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_p", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return keep_one(out, keys, [F.col("_p"), *map(F.col, order)]).drop("_p")


def merge_cache(target: DataFrame, source: DataFrame, key: str, stale: Column) -> DataFrame:
    """target and the rows of source that it lacks and that are not stale."""
    return target.unionByName(source.where(~stale).join(target.select(key), key, "left_anti"))


def cache_hits(wanted: DataFrame, cache: DataFrame, key: str, digest: str) -> DataFrame:
    """wanted with `reusable`: in the cache with an equal digest, or with one of them empty."""
    c = cache.select(key, F.col(digest).alias("_d"), F.lit(1).alias("_f"))
    a, b = F.coalesce(digest, F.lit("")), F.coalesce("_d", F.lit(""))
    ok = (F.col("_f") == 1) & ((a == b) | (a == "") | (b == ""))
    return wanted.join(c, key, "left").withColumn("reusable", F.coalesce(ok, F.lit(False))).drop("_d", "_f")


def short_spectra(k: int, ignore_failed: bool = False) -> Column:
    """Whether a stored sparse spectrum (status, eigenvalues) has fewer values than are asked for now; a failed one counts as
    short too, unless ignored."""
    sparse = F.coalesce((F.col("status") == "ok_sparse_topk") & (F.size("eigenvalues") < k), F.lit(False))
    return sparse if ignore_failed else sparse | F.coalesce(F.startswith("status", F.lit("failed")), F.lit(False))


def quantile_bins(df: DataFrame, column: str, out: str) -> DataFrame:
    """Number of inner distinct quartiles below the value."""
    q = quantiles(df, [], column, (0.0, 0.25, 0.5, 0.75, 1.0)).select(F.array_distinct("q").alias("_q"))
    inner = F.slice("_q", F.lit(2), F.greatest(F.lit(0), F.size("_q") - 2))
    return df.crossJoin(F.broadcast(q)).withColumn(out, F.size(F.filter(inner, lambda x: x < F.col(column)))).drop("_q")


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "measure", "value")


def plateau(history: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """First epoch from which the loss can fall by no more than a share of all it falls."""
    rest = least_after(history, keys, [F.col("epoch")], "loss", "_rest")
    ends = rest.groupBy(*keys).agg(F.min_by("loss", "epoch").alias("_first"), F.min("loss").alias("_min"))
    h = same(rest, ends, keys)
    ok = (F.col("loss") - F.col("_rest")) <= tolerance * (F.col("_first") - F.col("_min"))
    return h.groupBy(*keys).agg(F.min(F.when(ok, F.col("epoch"))).alias("plateau"))


def early_stop(history: DataFrame, keys: list[str], patience: int) -> DataFrame:
    """Best epoch and the epoch at which `patience` epochs without a better score are reached."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    past = F.max("score").over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("_up", (past.isNull() | (F.col("score") > past)).cast("int"))
    h = h.withColumn("_run", F.sum("_up").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("_bad", F.sum(1 - F.col("_up")).over(Window.partitionBy(*keys, "_run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)))
    stop = h.groupBy(*keys).agg(F.min(F.when(F.col("_bad") >= patience, F.col("epoch"))).alias("stop"), F.max("epoch").alias("last"))
    end = F.coalesce("stop", "last")
    seen = h.join(stop, keys).where((F.col("_up") == 1) & (F.col("epoch") <= end))
    return seen.groupBy(*keys).agg(F.max("epoch").alias("best_epoch"), F.first(end).alias("end"))


def within_lines(pairs: DataFrame, codes: DataFrame, low: int | None = None, high: int | None = None, key: str = "code_id") -> DataFrame:
    """Pairs whose both ends have a line count in the closed range; codes(key, lines)."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col("lines") >= low)
    if high is not None:
        ok = ok & (F.col("lines") <= high)
    return both_ends(pairs, codes.where(ok), key)


def strict_status(status: Column) -> Column:
    """No status, or plainly ok: spectra of the smallest values alone are left out."""
    return status.isNull() | (status == "ok")


def usable_programs(codes: DataFrame) -> DataFrame:
    """Codes that are no mutants, in a known language, with a text and a problem."""
    blank = F.trim(F.coalesce("code", F.lit(""))) == ""
    return codes.where(~F.coalesce("is_mutant", F.lit(False)) & F.col("language").isNotNull() & ~blank & F.col("problem_id").isNotNull() & (F.col("problem_id").cast("string") != ""))


def record_methods(entries: DataFrame, key: str, name: str) -> DataFrame:
    """Of each record the methods that carry its mark (m_<key>), or all if none does."""
    short = F.trim(F.substring_index(F.substring_index(F.col(name), ":", 1), ".", -1))
    marked = F.coalesce(short == F.concat(F.lit("m_"), F.col(key).cast("string")), F.lit(False))
    any_ = F.max(marked).over(Window.partitionBy(key))
    return entries.withColumn("_m", marked).withColumn("_a", any_).where("_m or not _a").drop("_m", "_a")


def complete_layers(graphs: DataFrame, layers: list[str], key: str = "code_id") -> DataFrame:
    """Keys that have nodes in every one of the layers."""
    g = graphs.where(F.col("layer").isin(*layers) & (F.col("num_nodes") > 0)).groupBy(key).agg(F.count_distinct("layer").alias("_n"))
    return g.where(F.col("_n") == len(layers)).select(key)


def prune_to_coverage(pairs: DataFrame, usable: DataFrame, key: str = "code_id") -> tuple[DataFrame, DataFrame]:
    """Pairs with both ends usable, and how many there were before and after by split."""
    kept = both_ends(pairs, usable, key)
    count = lambda d, n: d.groupBy("split").agg(F.count(F.lit(1)).alias(n))
    stats = count(pairs, "before").join(count(kept, "after"), "split", "left").fillna(0, ["after"])
    return kept, stats.withColumn("removed", F.col("before") - F.col("after"))


def method_of_dot(dots: DataFrame, methods: DataFrame, part: int = PART) -> DataFrame:
    """dots(dot, chunk, first_node, ordinal, name) with the method they belong to: that of their first node, else the one at
    their ordinal if the names agree. methods(chunk, node_id, place, full_name).

    Beyond `part` rows a shuffle partition the tables are dealt to more partitions, so what a task sorts doesn't grow with them.
    """
    by_node = methods.select("chunk", F.col("node_id").alias("first_node"), F.col("full_name").alias("_n"))
    by_place = methods.select("chunk", F.col("place").alias("ordinal"), F.col("full_name").alias("_p"))
    n = -(-(dots.count() + methods.count()) // part)
    more = n > int(dots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, key: df.repartition(n, "chunk", key) if more else df
    j = dealt(dots, "first_node").join(dealt(by_node, "first_node"), ["chunk", "first_node"], "left")
    j = dealt(j, "ordinal").join(dealt(by_place, "ordinal"), ["chunk", "ordinal"], "left")
    plain = lambda c: F.regexp_replace(F.trim(F.substring_index(c, ":", 1)), r"<duplicate>\d+$", "")
    full, name = plain(F.col("_p")), F.regexp_replace(F.trim("name"), r"<duplicate>\d+$", "")
    same = F.col("name").isNull() | ((name != "") & F.endswith(full, name))
    return j.withColumn("method", F.coalesce("_n", F.when(same, F.col("_p")))).drop("_n", "_p")


def tagged_union(parts: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """Union of tables of several datasets; their ids get the dataset's tag."""
    out = None
    for tag, df in parts:
        for c in columns:
            df = df.withColumn(c, F.concat_ws("_", F.lit(tag), F.col(c).cast("string")))
        out = df if out is None else out.unionByName(df)
    return out


def subtree_match(pairs: DataFrame, subtrees: DataFrame, slack: float = 0.20) -> DataFrame:
    """Pairs with the largest cosine of two of their subtrees whose sizes differ by at most a share of the left one's; 0 without
    any. subtrees(code_id, size, vector); within a pair there are few."""
    side = lambda p: subtrees.select(F.col("code_id").alias(f"{p}_id"), F.col("size").alias(f"{p}_size"), F.col("vector").alias(f"{p}_v"))
    j = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    j = j.where(F.abs(F.col("left_size") - F.col("right_size")) / F.greatest("left_size", F.lit(1)) <= slack)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot("left_v", "left_v")) * F.sqrt(dot("right_v", "right_v"))
    best = j.groupBy("left_id", "right_id").agg(F.max(F.coalesce(F.try_divide(dot("left_v", "right_v"), size), F.lit(0.0))).alias("similarity"))
    return pairs.join(best, ["left_id", "right_id"], "left").withColumn("similarity", F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0))))


def best_snapshot(runs: DataFrame, identity: str = "identity") -> DataFrame:
    """Of the snapshots of one run the one that is complete, then has the longest history, then most steps.

    Histories (arrays) of one identity must be the beginnings of the longest; others raise.
    """
    long = runs.groupBy(identity).agg(F.max_by("history", F.struct(F.size("history"), F.to_json("history"))).alias("_h"))
    j = runs.join(long, identity)
    same = F.slice("_h", F.lit(1), F.size("history")) == F.col("history")
    j = j.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("divergent histories of "), F.col(identity).cast("string")))))
    order = [F.desc("complete"), F.size("history").desc(), F.desc("steps"), F.col("source")]
    return keep_one(j.drop("_h"), [identity], order)


def complete_ranks(runs: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rank by falling score among the complete runs with a score, ties sharing the first; others have none."""
    ok = F.coalesce(F.col("complete") & F.col(score).isNotNull(), F.lit(False))
    ties = runs.where(ok).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    first = running(ties, keys, [F.desc(score)], {"_to": "_n"}).select(*keys, score, (F.col("_to") - F.col("_n") + 1).cast("int").alias("rank"))
    ranked = same(runs.withColumn("_ok", ok), first, [*keys, score], "left")
    return ranked.withColumn("rank", F.when(F.col("_ok"), F.col("rank"))).drop("_ok")


def ordered_names(names: DataFrame, column: str, priority: dict[str, int]) -> DataFrame:
    """Distinct names with their place: by priority, unknown ones last by name. A few rows."""
    p = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col(column)), F.lit(999))
    return names.select(column).distinct().withColumn("place", F.row_number().over(Window.orderBy(p, column)))


#: Scores of a label that a block holds at most.
BLOCK = 2048


def ranking_loss(scores: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, pairs, loss: the mean of ln(1 + exp(negative - positive)) over all pairs of a positive and a negative score of a
    batch; 0 where a batch lacks one of them.

    Both labels of a batch are dealt to blocks of about `block` rows, and every two blocks meet in one group, so a batch of any
    size is spread; a group gives two sums. Rows without a score take no part.
    """
    df = scores.where(F.col("score").isNotNull() & F.col("label").isNotNull()).select(*keys, (F.col("label") == 1).alias("_y"), F.col("score").cast("double").alias("_s"))
    df = stored(df.withColumn("_r", F.monotonically_increasing_id()), "losses")
    n = df.groupBy(*keys).agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(c) / block)).cast("int").alias(f"_{k}") for k, c in (("p", F.col("_y")), ("q", ~F.col("_y")))])
    df = same(df, n, keys)
    own = F.pmod(F.xxhash64("_r"), F.when(F.col("_y"), F.col("_p")).otherwise(F.col("_q"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("_y"), F.col("_q")).otherwise(F.col("_p")) - 1))
    met = df.select(*keys, "_y", "_s", own.alias("_own"), other.alias("_other"))
    met = met.select(*keys, "_y", "_s", F.when(F.col("_y"), F.col("_own")).otherwise(F.col("_other")).alias("_i"), F.when(F.col("_y"), F.col("_other")).otherwise(F.col("_own")).alias("_j"))
    blocks = met.groupBy(*keys, "_i", "_j").agg(*[F.sort_array(F.collect_list(F.when(c, F.col("_s")))).alias(k) for k, c in (("_a", F.col("_y")), ("_b", ~F.col("_y")))])

    @F.pandas_udf(DoubleType())
    def total(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(sum(np.logaddexp(0, ys - x).sum() for x in xs)) if len(ys) else 0.0 for xs, ys in zip(a, b, strict=True)], dtype="float64")

    part = blocks.select(*keys, (F.size("_a").cast("long") * F.size("_b")).alias("_n"), total("_a", "_b").alias("_t"))
    out = part.groupBy(*keys).agg(F.sum("_n").alias("pairs"), F.sum("_t").alias("_t"))
    return out.select(*keys, "pairs", F.when(F.col("pairs") > 0, F.col("_t") / F.col("pairs")).otherwise(F.lit(0.0)).alias("loss"))


def single_valued(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, the number of distinct values of every column, and whether all have one: what must hold before runs are pooled."""
    g = df.groupBy(*keys).agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("?"))).alias(f"n_{c}") for c in columns])
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.col(f"n_{c}") == 1)
    return g.withColumn("poolable", ok)


def require_single_valued(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df, or an error naming a group whose runs differ in one of the columns."""
    bad = single_valued(df, keys, columns).where("not poolable").limit(1).collect()
    if bad:
        raise ValueError(f"runs of {bad[0].asDict()} must not be pooled")
    return df
