"""Components, leakage-free splits, overlap and degree audits of pair graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .metrics import gini
from .ordered import draw, numbered_by, running, same
from .sampling import hash_fraction

BITS = {"train": 1, "valid": 2, "test": 4}


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of edges (a, b); a row without one of its ends is no edge.

    In each round nodes with edges form trees (`_trees`) of two nodes or more, and the edges between trees are the next round's.
    So there are at most log n rounds, and all edges are shuffled in the first alone. Long integers as nodes sort and shuffle least.
    """
    pair = stored(edges.select("a", "b").where("a is not null and b is not null"), "edges")
    between, levels = pair.where("a <> b"), []
    while not between.isEmpty():
        levels.append(up := _trees(between))
        half = between.join(up.select(F.col("node").alias("a"), "root"), "a").select(F.col("root").alias("a"), "b").distinct()
        both = half.join(up.select(F.col("node").alias("b"), "root"), "b").where("a <> root")
        between = stored(both.select(F.least("a", "root").alias("a"), F.greatest("a", "root").alias("b")).distinct(), "between")
    loops = pair.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    if not levels:
        return loops
    top = levels.pop()
    while levels:  # from the last round down, each round's nodes are joined once
        top = levels.pop().join(top.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return top if loops.isEmpty() else top.unionByName(loops.join(top, "node", "left_anti"))


def _trees(edges: DataFrame) -> DataFrame:
    """(node, root) of the trees in which every node of edges (a, b) hangs below its least neighbour; the root is the smallest.

    Every second node on the way up is no larger, so it ends in two nodes that point at each other, of which the smaller is the
    root. Only nodes with others below them are followed on, in steps that double.
    """
    end = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("up"))
    tree = stored(edges.select(F.inline(F.array(end("a", "b"), end("b", "a")))).groupBy("node").agg(F.min("up").alias("up")), "trees")
    inner = stored(tree.join(tree.select(F.col("up").alias("node")).distinct(), "node"), "inner")
    while True:
        over = inner.select(F.col("node").alias("up"), F.col("up").alias("_over"))
        up = F.when(F.col("_over") == F.col("node"), F.least("node", "up")).otherwise(F.col("_over"))
        step = stored(inner.join(over, "up").select("node", F.col("up").alias("_old"), up.alias("up")), "inner")
        inner = step.select("node", "up")
        if step.where("_old <> up").isEmpty():
            return stored(tree.join(inner.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root"), "trees")


def split_of(fraction: Column) -> Column:
    return F.when(fraction < 0.70, "train").when(fraction < 0.85, "valid").otherwise("test")


def hash_split(root: Column, salt: str) -> Column:
    """Split of a component by the hash of its root."""
    return split_of(hash_fraction(F.concat(F.lit(salt), root)))


def problem_splits(codes: DataFrame, seed: int = 42) -> DataFrame:
    """problem_id, root, split: problems that share a source text are one component."""
    links = codes.where("problem_id is not null and code is not null").select("problem_id", F.sha2("code", 256).alias("h")).distinct()
    lead = links.groupBy("h").agg(F.min("problem_id").alias("b"))
    edges = links.join(lead, "h").select(F.col("problem_id").alias("a"), "b").distinct()
    return components(edges).select(F.col("node").alias("problem_id"), "root", hash_split(F.col("root"), f"revision-problem-v1/{seed}/").alias("split"))


def provided_splits(codes: DataFrame) -> DataFrame:
    """code_id, root, split from given splits; components with several are excluded."""
    links = codes.select("code_id", "split", F.sha2("code", 256).alias("h"))
    lead = links.groupBy("h").agg(F.min("code_id").alias("b"))
    root = components(links.join(lead, "h").select(F.col("code_id").alias("a"), "b"))
    r = links.join(root, F.col("code_id") == F.col("node")).select("code_id", "root", "split")
    one = r.groupBy("root").agg(F.count_distinct(F.coalesce("split", F.lit("?"))).alias("n"), F.min("split").alias("s"), F.count_if(F.col("split").isNull()).alias("unknown"))
    name = F.when((F.col("n") > 1) | (F.col("unknown") > 0), "excluded_conflicting_component").otherwise(F.col("s"))
    return r.join(one, "root").select("code_id", "root", name.alias("split"))


def unordered(a: str = "left_id", b: str = "right_id") -> Column:
    return F.concat_ws("/", F.least(F.col(a).cast("string"), F.col(b).cast("string")), F.greatest(F.col(a).cast("string"), F.col(b).cast("string")))


def split_masks(pairs: DataFrame) -> DataFrame:
    """node, mask: bit 1 train, 2 valid, 4 test."""
    bit = F.create_map(*[x for k, v in BITS.items() for x in (F.lit(k), F.lit(v))])[F.col("split")]
    ends = pairs.select(F.explode(F.array("left_id", "right_id")).alias("node"), bit.alias("bit"))
    return ends.groupBy("node").agg(F.bit_or("bit").alias("mask"))


def leakage(pairs: DataFrame) -> DataFrame:
    """Nodes in two splits or more and in all; evaluation pairs with an endpoint seen in training."""
    m = split_masks(pairs)
    nodes = m.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.bit_count("mask") >= 2).alias("shared"), F.count_if(F.col("mask") == 7).alias("everywhere"))
    t = m.where(F.col("mask").bitwiseAND(1) == 1).select("node")
    e = pairs.where("split <> 'train'").join(t.select(F.col("node").alias("left_id"), F.lit(1).alias("l")), "left_id", "left").join(t.select(F.col("node").alias("right_id"), F.lit(1).alias("r")), "right_id", "left")
    s = e.agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.coalesce("l", "r").isNotNull()).alias("any_seen"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("both_seen"))
    return nodes.crossJoin(F.broadcast(s))


def degrees(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, node, incidence (pair rows) and neighbours (distinct others; a self-pair counts once)."""
    keys = keys or []
    a = pairs.select(*keys, F.col("left_id").alias("node"), F.col("right_id").alias("other"))
    b = pairs.where("left_id <> right_id").select(*keys, F.col("right_id").alias("node"), F.col("left_id").alias("other"))
    both = a.unionByName(b).groupBy(*keys, "node", "other").agg(F.count(F.lit(1)).alias("c"))
    return both.groupBy(*keys, "node").agg(F.sum("c").alias("incidence"), F.count(F.lit(1)).alias("neighbours"))


def degree_statistics(deg: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Quantiles, Gini, share of the top percent (at least one node) and counts from 2 up."""
    keys = keys or []
    base = deg.withColumn("_all", F.lit(1)) if not keys else deg
    k = keys or ["_all"]
    g = base.groupBy(*k).agg(F.count(F.lit(1)).alias("nodes"), F.avg(col).alias("mean"), F.max(col).alias("largest"), F.percentile(col, [0.5, 0.9, 0.99]).alias("q"), F.sum(col).alias("total"), *[F.count_if(F.col(col) >= n).alias(f"from_{n}") for n in (2, 5, 10, 20, 50, 100)])
    # the top share from counts of equal degrees, not from a sort of all nodes
    c = base.groupBy(*k, col).agg(F.count(F.lit(1)).alias("c")).join(g.select(*k, F.ceil(F.greatest(F.lit(1.0), F.col("nodes") * 0.01)).alias("top")), k)
    seen = F.sum("c").over(Window.partitionBy(*k).orderBy(F.desc(col)).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    part = F.greatest(F.lit(0), F.least(F.col("c"), F.col("top") - seen)) * F.col(col)
    top = c.withColumn("part", part).groupBy(*k).agg(F.sum("part").alias("top_sum"))
    out = g.join(top, k).join(gini(base, k, col), k)
    cols = [*keys, "nodes", F.round("mean", 6).alias("mean"), "largest", F.round(F.get("q", F.lit(0)), 6).alias("p50"), F.round(F.get("q", F.lit(1)), 6).alias("p90"), F.round(F.get("q", F.lit(2)), 6).alias("p99"), F.round("gini", 6).alias("gini"), F.round(F.col("top_sum") / F.col("total"), 6).alias("top_share"), *[f"from_{n}" for n in (2, 5, 10, 20, 50, 100)]]
    return out.select(*cols)


def integrity(pairs: DataFrame) -> DataFrame:
    """Self-pairs, repeated directed and undirected occurrences, labels unlike the first seen."""
    d = pairs.groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n"))
    directed = d.agg(F.sum(F.col("n") - 1).alias("repeated_directed"))
    first = pairs.withColumn("u", unordered()).groupBy("u").agg(F.min_by("label", "edge_id").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("ones"))
    # every occurrence whose label differs from the first one's is a conflict
    conflicts = F.when(F.col("first") == 1, F.col("n") - F.col("ones")).otherwise(F.col("ones"))
    u = first.agg(F.sum(F.col("n") - 1).alias("repeated_undirected"), F.sum(conflicts).alias("label_conflicts"))
    s = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("left_id") == F.col("right_id")).alias("self_pairs"))
    return s.crossJoin(F.broadcast(directed)).crossJoin(F.broadcast(u))


def component_sizes(root: DataFrame) -> DataFrame:
    s = root.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return s.agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"), F.sum("size").alias("nodes"), F.count_if(F.col("size") == 2).alias("pairs_only"))


def overlap(items: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split, by pair of splits."""
    s = items.select(F.col(key).alias("k"), F.col(split).alias("s")).distinct()
    a, b = s.select("k", F.col("s").alias("first")), s.select("k", F.col("s").alias("second"))
    return a.join(b, "k").where("first < second").groupBy("first", "second").agg(F.count(F.lit(1)).alias("shared"))


def overlaps(items: DataFrame, keys: dict[str, Column], split: str = "split") -> DataFrame:
    """kind, first, second, shared: the overlap by each of several keys."""
    rows = items.select(split, F.explode(F.create_map(*[x for k, c in keys.items() for x in (F.lit(k), c.cast("string"))])).alias("kind", "k")).distinct()
    a, b = rows.select("kind", "k", F.col(split).alias("first")), rows.select("kind", "k", F.col(split).alias("second"))
    return a.join(b, ["kind", "k"]).where("first < second").groupBy("kind", "first", "second").agg(F.count(F.lit(1)).alias("shared"))


def require_disjoint(items: DataFrame, keys: dict[str, Column], split: str = "split") -> DataFrame:
    """items, or an error naming the key that two splits share."""
    bad = overlaps(items, keys, split).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].first} and {bad[0].second} share {bad[0].shared} by {bad[0].kind}")
    return items


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """One row of each unordered pair and split, the first by its ends; an error if a pair has both labels."""
    u = pairs.withColumn("_u", unordered())
    n = u.groupBy("_u").agg(F.count_distinct("label").alias("n")).where("n > 1").limit(1).collect()
    if n:
        raise ValueError(f"conflicting labels for {n[0]._u}")
    w = Window.partitionBy("split", "_u").orderBy("left_id", "right_id")
    return u.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_u")


def _cells(codes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fragments with their place in a cell (split, language), blocks of equal problem and source there, and cells.

    A cell is ordered by problem and source, so the partners of a block that follow it are a range of places: up to the end of
    its problem those of its problem with other sources (positives), beyond it those of other problems (negatives).
    """
    keys = ["split", "language"]
    c = stored(codes.select("code_id", "problem_id", "language", "split", F.sha2("code", 256).alias("h")).where("problem_id is not null and h is not null"), "fragments")
    placed = stored(numbered_by(c, keys, [F.col("problem_id"), F.col("h"), F.col("code_id")], "place"), "placed")
    blocks = placed.groupBy(*keys, "problem_id", "h").agg(F.count(F.lit(1)).alias("m"), F.max("place").alias("end"))
    problems = blocks.groupBy(*keys, "problem_id").agg(F.max("end").alias("problem_end"))
    n = blocks.groupBy(*keys).agg(F.sum("m").alias("n"))
    blocks = same(same(blocks, problems, [*keys, "problem_id"]), n, keys)
    blocks = stored(blocks.withColumns({"w1": F.col("m") * (F.col("problem_end") - F.col("end")), "w0": F.col("m") * (F.col("n") - F.col("problem_end"))}), "blocks")
    two = F.col("m") * (F.col("m") - 1) / 2
    equal = blocks.groupBy(*keys, "h").agg(F.sum("m").alias("m"), F.sum(two).alias("inside")).groupBy(*keys).agg(F.sum(two - F.col("inside")).cast("long").alias("equal"))
    cells = same(blocks.groupBy(*keys).agg(F.sum("w1").alias("all1"), F.sum("w0").alias("all0")), equal, keys)
    # pairs with unequal sources: all positives that are counted, and negatives but for those of equal sources
    return placed, blocks, stored(cells.withColumns({"free1": F.col("all1"), "free0": F.col("all0") - F.col("equal")}), "cells")


def _unranked(numbers: DataFrame, blocks: DataFrame, placed: DataFrame, label: int) -> DataFrame:
    """numbers (split, language, t, number) as pairs (split, language, t, left_id, right_id) with unequal sources."""
    keys = ["split", "language"]
    own = blocks.where(F.col(f"w{label}") > 0)
    upto = running(own, keys, [F.col("problem_id"), F.col("h")], {"_to": f"w{label}", "block": F.lit(1).cast("long")})
    upto = stored(upto.withColumn("start", F.col("_to") - F.col(f"w{label}")), "ranges")
    marks = upto.select(*keys, F.col("start").alias("number"), F.lit(1).cast("long").alias("is_block"), F.lit(None).cast("long").alias("t"))
    both = marks.unionByName(numbers.select(*keys, "number", F.lit(0).cast("long").alias("is_block"), "t"))
    at = running(both, keys, [F.col("number"), F.desc("is_block"), F.col("t")], {"block": "is_block"}).where("t is not null")
    at = same(at.select(*keys, "t", "number", "block"), upto.select(*keys, "block", "start", "m", "end", "problem_end", "n"), [*keys, "block"])
    first = F.col("end") if label else F.col("problem_end")
    width = (F.col("problem_end") if label else F.col("n")) - first
    off = F.col("number") - F.col("start")
    at = at.withColumns({"i": F.col("end") - F.col("m") + 1 + F.floor(off / width), "j": first + 1 + off % width})
    side = lambda c: placed.select(*keys, F.col("place").alias(c), F.col("code_id").alias(f"{c}_id"), F.col("h").alias(f"{c}_h"))
    got = same(same(at.select(*keys, "t", "i", "j"), side("i"), [*keys, "i"]), side("j"), [*keys, "j"]).where("i_h <> j_h")
    return got.select(*keys, "t", F.least("i_id", "j_id").alias("left_id"), F.greatest("i_id", "j_id").alias("right_id"))


def generate_pairs(codes: DataFrame, per_cell: int, seed: int = 42) -> DataFrame:
    """As many positives as negatives for each (split, language): per_cell of either, or as many as the scarcer label has.

    Positives share a problem, negatives do not, and sources differ. All pairs of a cell are numbered without being formed: a
    draw is a number by hash, unranked to a pair. Repeated numbers and equal sources are passed over, and draws go on until
    the quota is met; a cell with few pairs has all of them drawn. A quota is met whenever the data has so many pairs.
    """
    keys = ["split", "language"]
    placed, blocks, cells = _cells(codes)
    out = None
    for label in (1, 0):
        quota = F.least(F.lit(per_cell), "free1", "free0").cast("long")
        want = cells.select(*keys, F.col(f"all{label}").alias("all"), quota.alias("_w")).where("_w > 0")
        salt = lambda t: F.sha2(F.concat_ws("/", F.lit(f"{seed}/{label}"), "split", "language", t.cast("string")), 256)  # noqa: B023, E731
        draws = 2
        while True:
            few = F.col("all") <= per_cell * draws  # all numbers, in the order of their hashes
            numbers = want.withColumn("t", F.explode(F.sequence(F.lit(0), F.when(few, F.col("all") - 1).otherwise(F.lit(per_cell * draws).cast("long")))))
            drawn = F.pmod(F.conv(F.substring(salt(F.col("t")), 1, 15), 16, 10).cast("long"), F.col("all"))
            numbers = numbers.withColumn("number", F.when(few, F.col("t")).otherwise(drawn)).groupBy(*keys, "number").agg(F.min("t").alias("t"), F.first(few).alias("few"))
            numbers = stored(numbers, "numbers")
            pairs = stored(same(_unranked(numbers, blocks, placed, label), numbers.select(*keys, "t", "few"), [*keys, "t"]), "drawn")
            have = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"))
            if same(want, have, keys, "left").where("coalesce(have, 0) < _w").isEmpty():
                break
            draws *= 2
        order = F.when(F.col("few"), salt(F.col("t"))).otherwise(F.lpad(F.col("t").cast("string"), 20, "0"))
        some = draw(pairs.withColumn("label", F.lit(label)), keys, order, ["t"], want.select(*keys, "_w")).drop("t", "few")
        out = some if out is None else out.unionByName(some)
    return out.select(*keys, "left_id", "right_id", "label")
