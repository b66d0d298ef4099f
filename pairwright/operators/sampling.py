"""Deterministic sampling by hash rank, quotas and greedy selections.

A row's rank is the SHA-256 of "seed:id": the same rows are drawn whatever the partitioning.
Quotas that follow from the data are drawn by `ordered.draw`, which no stratum is too large for;
for a fixed k `WindowGroupLimit` keeps the first k rows of each task before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import numbered, stored
from .ordered import draw, numbered_by, running


def hash_rank(id_col: Column, seed) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")), 256)


def hash_fraction(text: Column) -> Column:
    """First 16 hex digits of SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def hash_choice(text: Column, n: Column) -> Column:
    """First 8 bytes of SHA-256 modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)"), n.cast("decimal(20,0)")).cast("int")


def _draw(df: DataFrame, strata: list[str], id_col: str, seed, quota: DataFrame) -> DataFrame:
    return draw(df, strata, hash_rank(F.col(id_col), seed), [id_col], quota)


def _two(counts: DataFrame, label: str, one: str, zero: str) -> DataFrame:
    """Quotas of labels 1 and 0 from a row that has both."""
    return counts.select(F.inline(F.array(*[F.struct(F.lit(y).alias(label), F.col(c).cast("long").alias("_w")) for y, c in ((1, one), (0, zero))])))


def top_k(df: DataFrame, strata: list[str], id_col: str, k: int, seed) -> DataFrame:
    """The k rows of each stratum, or of all, with the smallest hash."""
    if not strata:
        return df.orderBy(hash_rank(F.col(id_col), seed), id_col).limit(k)
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_rank(F.col(id_col), seed), id_col))
    return df.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")


def proportional_cap(df: DataFrame, label: str, id_col: str, cap: int, seed) -> DataFrame:
    """At most about `cap` rows: of each label its share, rounded half to even, at least one."""
    total = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = total.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_t"))))
    want = F.when(F.col("_t") <= cap, F.col("_n")).otherwise(F.greatest(F.lit(1), F.bround(F.lit(float(cap)) * F.col("_n") / F.col("_t"), 0).cast("long")))
    return _draw(df.where(F.col(label).isNotNull()), [label], id_col, seed, total.select(label, want.alias("_w")))


def balanced(df: DataFrame, label: str, id_col: str, n: int, seed) -> DataFrame:
    """Half of each label, topped up from the other where one is short."""
    c = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    p, q = F.least("p", F.lit(n // 2)), F.least("q", F.lit(n - n // 2))
    take1, take0 = F.least("p", F.lit(n) - q), F.least("q", F.lit(n) - p)
    return _draw(df, [label], id_col, seed, _two(c.select(take1.alias("_1"), take0.alias("_0")), label, "_1", "_0"))


def exact_quota(df: DataFrame, strata: list[str], id_col: str, k: int, seed) -> DataFrame:
    """Exactly k rows of each stratum; fails where a stratum has fewer."""
    n = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    enough = F.when(F.col("_n") < k, F.raise_error(F.lit(f"a stratum has fewer than {k} rows"))).otherwise(F.lit(k))
    return _draw(df, strata, id_col, seed, n.select(*strata, enough.cast("long").alias("_w")))


def matched(df: DataFrame, cell: list[str], label: str, id_col: str, seed) -> DataFrame:
    """In every cell as many rows of each label as the scarcer label has; cells lacking one vanish."""
    n = df.groupBy(*cell).agg(F.least(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).alias("_w"))
    quota = n.select(*cell, F.explode(F.array(F.lit(0), F.lit(1))).alias(label), "_w")
    return _draw(df, [*cell, label], id_col, seed, quota)


def hard_negatives(df: DataFrame, score: str, id_col: str, fraction: float) -> DataFrame:
    """The highest-scored negatives: max(1, floor(n * fraction)) of them."""
    neg = df.where("label = 0")
    n = neg.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * fraction)).alias("_m"))
    return numbered(neg, [F.desc(score), F.col(id_col)], "_k").crossJoin(F.broadcast(n)).where(F.col("_k") <= F.col("_m")).drop("_k", "_m")


def negatives(candidates: DataFrame, known: DataFrame, n: int, seed) -> DataFrame:
    """n candidate pairs that are not known in either direction, drawn by hash; an error if there are fewer."""
    from .relational import unknown_pairs

    free = unknown_pairs(candidates.select("left_id", "right_id"), known.select("left_id", "right_id"))
    got = top_k(free.withColumn("_id", F.concat_ws("/", "left_id", "right_id")), [], "_id", n, seed).drop("_id")
    enough = got.agg(F.when(F.count(F.lit(1)) < n, F.raise_error(F.lit(f"fewer than {n} pairs are free"))).otherwise(F.lit(True)).alias("_ok"))
    return got.crossJoin(F.broadcast(enough)).where("_ok").drop("_ok")


def stable_choice(candidates: DataFrame, anchor: str, order: list[str]) -> DataFrame:
    """One candidate of each anchor: place int(SHA-256(anchor)[:8]) mod n in the given order."""
    n = candidates.groupBy(anchor).agg(F.count(F.lit(1)).alias("_n"))
    c = numbered_by(candidates, [anchor], [F.col(x) for x in order], "_k").withColumn("_k", F.col("_k") - 1).join(n, anchor)
    return c.where(F.col("_k") == hash_choice(F.col(anchor).cast("string"), F.col("_n"))).drop("_k", "_n")


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int, ties: str = "first") -> DataFrame:
    """Whole quotas that sum to `total`: floors, then the largest fractions; of equal ones the first key, or the last."""
    s = weights.crossJoin(F.broadcast(weights.agg(F.sum(weight).alias("_s"))))
    exact = F.col(weight) * F.lit(float(total)) / F.col("_s")
    s = s.withColumn("_f", F.floor(exact)).withColumn("_r", F.round(exact - F.floor(exact), 9))
    left = s.agg((F.lit(total) - F.sum("_f")).alias("_left"))
    order = [F.desc("_r"), F.col(key) if ties == "first" else F.col(key).desc()]
    return numbered(s, order, "_k").crossJoin(F.broadcast(left)).select(key, weight, (F.col("_f") + (F.col("_k") <= F.col("_left")).cast("long")).alias("quota"))


def bucket_targets(total: int, buckets: int, shares=(0.70, 0.15, 0.15)) -> np.ndarray:
    """Targets (buckets x splits) with equal bucket totals; of equal fractions every second bucket favours the last split, so that
    the two small splits come out alike."""
    if total <= 0 or buckets <= 0:
        raise ValueError("a positive total and some buckets are needed")
    out = np.zeros((buckets, len(shares)), int)
    for b in range(buckets):
        n = total // buckets + (b < total % buckets)
        raw = np.array([n * s for s in shares])
        out[b] = np.floor(raw)
        favoured = [0, 1, 2] if b % 2 == 0 else [0, 2, 1]
        for i in sorted(range(len(shares)), key=lambda i: (-(raw[i] - out[b, i]), favoured.index(i)))[: n - out[b].sum()]:  # noqa: B023
            out[b, i] += 1
    return out


def capacity_quotas(wanted: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Targets (groups x splits) within capacities: row and column sums are those wanted, and as few units as can be lie beyond
    what was wanted of their cell.

    Cheapest augmenting paths in the table of at most a few dozen cells: a unit that does not fit goes to another cell of its
    row, for which another row gives way there; a unit beyond what a cell wanted costs one, taking it back pays it again.
    """
    x = np.minimum(wanted, capacity).astype(int)
    rows, cols = wanted.sum(1), wanted.sum(0)
    n, m = x.shape
    while (need := rows - x.sum(1)).any():
        row, col = np.where(need > 0, 0.0, np.inf), np.full(m, np.inf)
        from_row, from_col = np.full(m, -1), np.full(n, -1)
        for _ in range(n + m):
            into = np.where(x < capacity, (x >= wanted) * 1.0, np.inf) + row[:, None]
            better = into.min(0) < col - 1e-9
            col[better], from_row[better] = into.min(0)[better], into.argmin(0)[better]
            back = np.where(x > 0, (x > wanted) * -1.0, np.inf) + col[None, :]
            nearer = back.min(1) < row - 1e-9
            row[nearer], from_col[nearer] = back.min(1)[nearer], back.argmin(1)[nearer]
            if not better.any() and not nearer.any():
                break
        room = cols - x.sum(0)
        goal = int(np.where(room > 0, col, np.inf).argmin())
        if room[goal] <= 0 or not np.isfinite(col[goal]):
            raise ValueError("capacities do not allow the quotas")
        path, j = [], goal
        while True:
            i = int(from_row[j])
            path.append((i, j, 1))
            if from_col[i] < 0:
                break
            j = int(from_col[i])
            path.append((i, j, -1))
        limit = [int(need[path[-1][0]]), int(room[goal])]
        for i, j, way in path:
            edge = (wanted if x[i, j] < wanted[i, j] else capacity)[i, j] - x[i, j] if way > 0 else x[i, j] - (wanted[i, j] if x[i, j] > wanted[i, j] else 0)
            limit.append(int(edge))
        for i, j, way in path:
            x[i, j] += way * min(limit)
    return x


def prevalence_cap(df: DataFrame, label: str, id_col: str, cap: int | None, prevalence: float, seed) -> DataFrame:
    """At most `cap` rows in which label 1 has the given share, as many as both labels allow; an error without one of them."""
    c = df.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q"))
    n = F.least(F.col("_p") + F.col("_q"), F.lit(cap) if cap else F.col("_p") + F.col("_q"), F.floor(F.col("_p") / prevalence), F.floor(F.col("_q") / (1 - prevalence)))
    c = c.withColumn("_n", n).withColumn("_1", F.least(F.col("_p"), F.bround(F.col("_n") * F.lit(prevalence), 0).cast("long"))).withColumn("_0", F.least(F.col("_q"), F.col("_n") - F.col("_1")))
    c = c.select(F.when((F.col("_1") > 0) & (F.col("_0") > 0), F.col("_1")).otherwise(F.raise_error(F.lit("too few rows of one label"))).cast("long").alias("_1"), "_0")
    other = F.when(F.col(label) == 1, 1).when(F.col(label).isNotNull(), 0).alias("_y")
    return _draw(df.withColumn("_y", other), ["_y"], id_col, seed, _two(c, "_y", "_1", "_0")).drop("_y")


def greedy_cover(pairs: DataFrame, n: int, seed) -> DataFrame:
    """n pairs that cover as many endpoints as they can: in hash order, first those that bring a new endpoint, then the others.

    A pair brings a new endpoint if it is the first pair of one of its ends, so no pass over all pairs in order is needed.
    """
    h = pairs.select("left_id", "right_id", hash_rank(F.concat_ws("/", "left_id", "right_id"), seed).alias("_h"))
    first = h.select(F.explode(F.array("left_id", "right_id")).alias("end"), "_h", "left_id", "right_id").groupBy("end").agg(F.min(F.struct("_h", "left_id", "right_id")).alias("x"))
    new = first.select("x.left_id", "x.right_id").distinct().withColumn("_f", F.lit(0))
    return h.join(new, ["left_id", "right_id"], "left").orderBy(F.coalesce("_f", F.lit(1)), "_h", "left_id", "right_id").limit(n).select("left_id", "right_id")


def budget_select(pairs: DataFrame, n: int, budget: int, seed) -> DataFrame:
    """n pairs in hash order with at most `budget` distinct endpoints in all; no limit of either where it is 0.

    What a pass in order does: it takes each pair whose new endpoints fit, and then passed-over pairs whose ends it has by
    then. Up to the first pair that does not fit all are taken, which is where the running number of first occurrences exceeds
    the budget. One endpoint may be free then: the first pair that brings just one takes it. After that only pairs between
    known endpoints fit. So two ranks and one endpoint decide every pair; no list of them leaves the tables.
    """
    order = ["_h", "left_id", "right_id"]
    h = pairs.select("left_id", "right_id", hash_rank(F.concat_ws("/", "left_id", "right_id"), seed).alias("_h"))
    ends = [F.least("left_id", "right_id").alias("_a"), F.greatest("left_id", "right_id").alias("_b")]
    h = h.groupBy(*ends).agg(F.min(F.struct(*order)).alias("_x")).select("_x.*")
    limit = F.lit(n if n > 0 else (1 << 62))
    ranked = stored(numbered(h, [F.col(c) for c in order], "_k").drop("_h"), "ranked")
    if budget <= 0:
        return ranked.where(F.col("_k") <= limit).select("left_id", "right_id")
    first = ranked.select(F.explode(F.array("left_id", "right_id")).alias("_e"), "_k").groupBy("_e").agg(F.min("_k").alias("_f"))
    first = stored(first, "first")
    for side in ("left", "right"):
        ranked = ranked.join(first.select(F.col("_e").alias(f"{side}_id"), F.col("_f").alias(f"_{side}")), f"{side}_id")
    itself = F.col("left_id") == F.col("right_id")
    new = (F.col("_left") == F.col("_k")).cast("long") + ((F.col("_right") == F.col("_k")) & ~itself).cast("long")
    seen = stored(running(ranked, [], [F.col("_k")], {"_seen": new}), "seen")
    stop = seen.where(F.col("_seen") > budget).agg(F.min("_k").alias("k")).first().k
    if stop is None:
        return seen.where(F.col("_k") <= limit).select("left_id", "right_id")
    known = [F.col(f"_{side}") < stop for side in ("left", "right")]
    have = seen.where(F.col("_k") < stop).agg(F.coalesce(F.max("_seen"), F.lit(0)).alias("n")).first().n
    last = None
    if have < budget:  # by one
        one = seen.where((F.col("_k") >= stop) & ((known[0] != known[1]) | (itself & ~known[0])))
        last = one.orderBy("_k").select("_k", F.when(known[0], F.col("right_id")).otherwise(F.col("left_id")).alias("x")).first()
    late = F.lit(False)
    inside = known
    if last is not None:
        inside = [k | (F.col(f"{side}_id") == F.lit(last.x)) for k, side in zip(known, ("left", "right"), strict=True)]
        late = (F.col("_k") < last._k) & ~(known[0] & known[1]) & (F.col("_k") >= stop)
    taken = seen.where((F.col("_k") < stop) | (inside[0] & inside[1])).withColumn("_late", late)
    return taken.orderBy("_late", "_k").limit(n).select("left_id", "right_id") if n > 0 else taken.select("left_id", "right_id")


def fixed_sample(df: DataFrame, label: str, id_col: str, n: int, seed) -> DataFrame:
    """n rows with the share of label 1 kept, at least one of each label; df itself if it has no more.

    A label that is short is topped up from the other. The order of df is that of its ids, which the rows keep.
    """
    c = df.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q"))
    want = F.greatest(F.lit(1), F.least(F.lit(n - 1), F.bround(F.lit(float(n)) * F.col("_p") / (F.col("_p") + F.col("_q")), 0).cast("long")))
    zero = F.least(F.lit(n) - F.least(want, F.col("_p")), F.col("_q"))
    c = c.select(F.when(F.col("_p") + F.col("_q") <= n, F.col("_p")).otherwise(F.lit(n) - zero).alias("_1"), F.when(F.col("_p") + F.col("_q") <= n, F.col("_q")).otherwise(zero).alias("_0"))
    other = F.when(F.col(label) == 1, 1).when(F.col(label).isNotNull(), 0).alias("_y")
    return _draw(df.withColumn("_y", other), ["_y"], id_col, seed, _two(c, "_y", "_1", "_0")).drop("_y")


def code_disjoint_split(pairs: DataFrame, seed: int, trials: int, shares=(0.70, 0.15, 0.15), names=("train", "valid", "test")) -> DataFrame:
    """left_id, right_id, label, split: the assignment of codes to splits, among `trials`, that leaves most pairs of each class.

    Trial t orders the codes by the hash of seed + t and cuts them by the shares; pairs within one split remain. A quota
    of q pairs a class is shared by largest remainder; the largest q that every split can fill counts, and the earliest of
    the best trials wins. From its pairs the quota is drawn by hash.
    """
    ids = stored(pairs.select(F.explode(F.array("left_id", "right_id")).alias("code")).distinct(), "codes")
    total = ids.count()
    if not total:
        raise ValueError("no pairs to split")
    ends = np.cumsum(_allocate(total, shares))
    which = lambda k: F.coalesce(*[F.when(k <= int(e), i) for i, e in enumerate(ends[:-1])], F.lit(len(names) - 1))
    at = None
    for t in range(trials):
        one = numbered(ids, [hash_rank(F.col("code"), seed + t), F.col("code")], "k").select("code", F.struct(F.lit(t).alias("t"), which(F.col("k")).alias("s")).alias("x"))
        at = one if at is None else at.unionByName(one)
    # a row for each code with its splits by trial, so pairs meet either end once and not once a trial
    at = at.groupBy("code").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]).alias("_at"))
    both = pairs.join(at.withColumnsRenamed({"code": "left_id", "_at": "_a"}), "left_id").join(at.withColumnsRenamed({"code": "right_id", "_at": "_b"}), "right_id")
    # a pair's split by trial, null where its ends are in two
    both = both.withColumn("_at", F.zip_with("_a", "_b", lambda x, y: F.when(x == y, x))).drop("_a", "_b")
    both = stored(both.where(F.exists("_at", lambda x: x.isNotNull())), "trials")
    cells = both.select("label", F.posexplode("_at").alias("t", "s")).where("s is not null").groupBy("t", "s", "label").count().collect()  # six cells a trial
    best = None
    for t in range(trials):
        n = {(names[r.s], r.label): r["count"] for r in cells if r.t == t}
        low, high = 0, sum(min(n.get((s, 1), 0), n.get((s, 0), 0)) for s in names)
        while low < high:
            middle = (low + high + 1) // 2
            fits = all(q <= n.get((s, y), 0) for s, q in zip(names, _allocate(middle, shares), strict=True) for y in (0, 1))
            low, high = (middle, high) if fits else (low, middle - 1)
        if best is None or low > best[0]:
            best = (low, t)
    kept = both.withColumn("split", F.get(F.array(*map(F.lit, names)), F.get("_at", F.lit(best[1])))).where("split is not null").drop("_at")
    quota = pairs.sparkSession.createDataFrame([(s, y, int(q)) for s, q in zip(names, _allocate(best[0], shares), strict=True) for y in (0, 1)], "split string, label int, _w long")
    r = _draw(kept.withColumn("_id", F.concat_ws("/", "left_id", "right_id")), ["split", "label"], "_id", seed + 10_000, quota)
    return r.select("left_id", "right_id", "label", "split")


def _allocate(total: int, shares) -> list[int]:
    """Whole shares of a total, by largest remainder; of equal ones the later name first."""
    raw = [total * s for s in shares]
    out = [int(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: (raw[i] - out[i], ("train", "valid", "test")[i] if len(raw) == 3 else i), reverse=True)[: total - sum(out)]:
        out[i] += 1
    return out


def balance_to_coverage(pairs: DataFrame, available: DataFrame, seed: int, key: str = "code_id") -> DataFrame:
    """Pairs whose ends are available, and of each split as many of either label as the scarcer has."""
    one = available.select(key).distinct()
    live = pairs.join(one.withColumnRenamed(key, "left_id"), "left_id", "left_semi").join(one.withColumnRenamed(key, "right_id"), "right_id", "left_semi")
    return matched(live.withColumn("_id", F.concat_ws("/", "left_id", "right_id")), ["split"], "label", "_id", seed).drop("_id")


def trim_majority(selected: DataFrame, source: DataFrame, label: str, order: str) -> DataFrame:
    """Without the last rows of the more frequent label, if the source had as many of either and the selection has not."""
    count = lambda d, p: d.agg(F.count_if(F.col(label) == 1).alias(f"{p}1"), F.count_if(F.col(label) == 0).alias(f"{p}0"))
    c = count(selected, "_s").crossJoin(F.broadcast(count(source, "_o")))
    uneven = (F.col("_o1") == F.col("_o0")) & (F.col("_s1") != F.col("_s0")) & (F.col("_s1") > 0) & (F.col("_s0") > 0)
    c = c.select(F.when(uneven, F.least("_s1", "_s0")).otherwise(F.greatest("_s1", "_s0")).alias("_m"))
    out = None
    for y in (0, 1):
        part = numbered(selected.where(F.col(label) == y), [F.col(order)], "_k").crossJoin(F.broadcast(c)).where(F.col("_k") <= F.col("_m")).drop("_k", "_m")
        out = part if out is None else out.unionByName(part)
    return out
