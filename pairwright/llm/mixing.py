"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: all words of the corpus, shared by weight, at
most `most` times the words it has; what is above is shared again among the others. Within a
source a document is expected min(most, c * measure) times, where its measure grows with the
logarithm of its size and c makes the expected words meet the target. Whole expected copies
are certain; the fraction is its inclusion probability in a fixed-size sample: documents are
ranked by random odds over inclusion odds and taken until the words left to the target are
reached. Then, up to `CORRECTIONS` times, the document next in rank to the cut that halves
the words still missing (or too many) is drawn or taken back. The place where a source's ranking
is cut is found with two levels of bins, so no source is ever sorted in one task.

Random numbers are hashes of seed, id, source and size, and all sums are of whole numbers:
reruns agree. Cases: a null text has size 0 and is taken 0 words; a null source is a source
of its own, last in order; a text of any length counts whole; rows that repeat are documents of
their own, which tie in rank: as many of them as the cut asks for are taken, whichever; the same
id and text in other sources is decided there; empty tables give empty results; extra columns are
kept by `copies`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shuffle_parts, written

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 17
BINS = 4096
#: Single draws that bring each source's sample nearer to its words.
CORRECTIONS = 3
#: Up to so many sources their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 50_000


def _numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 0 in the given order, without gathering the rows in one task."""
    n = shuffle_parts(df.sparkSession)
    parts = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "mix-order")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, rank).join(base, "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")


def _attach(df: DataFrame, small: DataFrame, rows: int) -> DataFrame:
    """Left join on `src`: broadcast only if small has few rows, else by shuffle (skew is split)."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, "src", "left")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """(src, source_size, target) from (src, source, size), and the number of sources."""
    totals = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    ranked = _numbered(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("src", "source_size", weight.cast("double").alias("weight")), "mix-sources")
    full = F.col("source_size") * most
    total, mass, n = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0)), F.count(F.lit(1))).first()
    share, capped = total / mass if mass else 0.0, -1
    while True:
        over = full < F.col("weight") * share
        used, left, now = ranked.agg(F.sum(F.when(over, full).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if now == capped or not left:
            break
        capped, share = now, (total - used) / left
    return ranked.select("src", "source_size", F.least(full.cast("double"), F.col("weight") * share).alias("target")), n


def uniform(seed: int) -> Column:
    """A number between 0 and 1 from a row's id, source and size: 48 bits of SHA-256, the same in any engine."""
    text = F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null")), "src", F.col("size").cast("string"))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def sample(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """(row, id, size, source_size, target, copies) for every row of docs.

    `row` is a unique number of each row; the high bits of it name a part of the table that fits a task.
    """
    row = F.monotonically_increasing_id() if row is None else row
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    sizes = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("did"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("rid"), src.alias("src"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    sizes = written(sizes.withColumn("measure", F.floor(F.log2(F.col("size") + 2) * 64 + 1e-6).cast("long")), "mix-sizes")
    goal, n = targets(sizes, weights, most)
    goal = written(goal, "mix-targets")

    # c of each source: documents expected `most` times are settled, the others share what is left
    c = _scales(sizes, goal, n, most)
    m = F.least(F.lit(float(most)), F.col("c") * F.col("measure"))
    rows = _attach(sizes, goal.join(c, "src"), n).withColumn("m", m)
    whole = F.floor(F.col("m") + 1e-9).cast("int")
    rows = rows.withColumn("whole", whole).withColumn("f", F.greatest(F.lit(0.0), F.col("m") - F.col("whole")))
    u = uniform(seed)
    odds = (u / (1 - u)) / (F.col("f") / (1 - F.col("f")))
    g = F.when((F.col("f") > 1e-9) & (F.col("size") > 0), odds / (1 + odds))
    b1 = F.least(F.lit(BINS - 1), F.floor(F.col("g") * BINS))
    b2 = F.least(F.lit(BINS - 1), F.floor((F.col("g") * BINS - F.col("b1")) * BINS))
    rows = written(rows.withColumn("g", g).withColumn("b1", b1).withColumn("b2", b2).drop("m", "f", "measure", "c"), "mix-ranks")

    left = rows.groupBy("src").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))
    drawn = rows.where("g is not null")
    one = _crossing(drawn.groupBy("src", "b1").agg(F.sum("size").alias("w")), left, "b1").select("src", F.col("b1").alias("c1"), F.col("rest").alias("rest1"))
    one = written(one, "mix-cut1")
    inside = _attach(drawn, one, n).where("b1 = c1")
    two = _crossing(inside.groupBy("src", "b2").agg(F.sum("size").alias("w")), one.select("src", F.col("rest1").alias("rest")), "b2").select("src", F.col("b2").alias("c2"), F.col("rest").alias("rest2"))
    two = written(two, "mix-cut2")
    cut = written(one.join(two, "src", "left"), "mix-cuts")
    rows = _attach(rows, cut, n)
    before = (F.col("b1") < F.col("c1")) | (F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2"))
    border = (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))
    rows = rows.withColumn("at", F.coalesce((F.col("c1") + F.coalesce("c2", F.lit(0)) / BINS) / BINS, F.lit(1.0)))
    rest = rows.where(~F.coalesce(border, F.lit(False))).withColumn("extra", F.coalesce((F.col("g").isNotNull() & (F.col("c1").isNull() | before)).cast("int"), F.lit(0)))
    both = written(rest.unionByName(_border(rows.where(border), n)).select("row", "id", "did", "rid", "src", "size", "source_size", "target", "whole", "extra", "g", "at"), "mix-drawn")
    # the sample is fixed in words: next in rank to the cut, one draw more or one taken back that halves what is amiss
    for _ in range(CORRECTIONS):
        gap = both.groupBy("src").agg((F.max("target") - F.sum((F.col("whole") + F.col("extra")) * F.col("size"))).alias("gap"))
        near = _attach(both.where("g is not null"), gap, n).withColumn("d", F.when(F.col("extra") == 1, -F.col("size")).otherwise(F.col("size")))
        near = near.where("abs(gap - d) <= abs(gap) / 2 and abs(gap) > 0").withColumn("far", F.abs(F.col("g") - F.col("at")))
        last = near.groupBy("src").agg(F.min(F.struct("far", "did", "rid", "row")).alias("x")).select("src", F.col("x.row").alias("flip"))
        both = _attach(both, written(last, "mix-last"), n)
        both = both.withColumn("extra", F.when(F.col("row") == F.coalesce("flip", F.lit(-1)), 1 - F.col("extra")).otherwise(F.col("extra"))).drop("flip")
    return both.select("row", "id", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def _border(edge: DataFrame, n: int) -> DataFrame:
    """Whether each row of the bin that holds the cut is taken: the only rows that are ranked exactly.

    Rows that repeat are one entry of the ranking, with their number.
    """
    keys = edge.groupBy("src", "g", "did", "rid", "size", "rest2").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("src").orderBy("g", "did", "rid").rowsBetween(Window.unboundedPreceding, 0)
    x = (F.col("rest2") - F.sum(F.col("n") * F.col("size")).over(w) + F.col("n") * F.col("size")) / F.col("size")
    keys = keys.withColumn("x", x).withColumn("k", F.least("n", F.greatest(F.lit(0), F.floor("x") + (F.col("x") - F.floor("x") > 0.5).cast("int"))))
    last = keys.where("k > 0").groupBy("src").agg(F.max(F.struct("g", "did", "rid", "k", "n")).alias("last"))
    mine, cut = F.struct("g", "did", "rid"), F.struct("last.g", "last.did", "last.rid")
    edge = _attach(edge, written(last, "mix-border"), n).withColumn("tied", F.coalesce((mine == cut) & (F.col("last.k") < F.col("last.n")), F.lit(False)))
    sure = edge.where("not tied").withColumn("extra", F.coalesce((mine <= cut).cast("int"), F.lit(0)))
    # which of the rows that repeat makes no difference: they are numbered part by part
    tied = edge.where("tied").withColumn("part", F.shiftright("row", 33))
    base = tied.groupBy("src", "part").agg(F.count(F.lit(1)).alias("m")).withColumn("base", F.sum("m").over(Window.partitionBy("src").orderBy("part")) - F.col("m"))
    rank = F.row_number().over(Window.partitionBy("src", "part").orderBy("row")) - 1
    tied = tied.withColumn("rank", rank).join(base.drop("m"), ["src", "part"]).withColumn("extra", (F.col("base") + F.col("rank") < F.col("last.k")).cast("int"))
    return sure.drop("last", "tied").unionByName(tied.drop("last", "tied", "part", "rank", "base"))


def _crossing(bins: DataFrame, rest: DataFrame, name: str) -> DataFrame:
    """The bin of each source in which its words run over `rest`, and what is left for it."""
    run = F.sum("w").over(Window.partitionBy("src").orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    over = bins.withColumn("run", run).join(rest, "src").where("run > rest")
    first = over.groupBy("src").agg(F.min_by(F.struct(name, (F.col("rest") - F.col("run") + F.col("w")).alias("rest")), name).alias("x"))
    return first.select("src", f"x.{name}", "x.rest")


def _scales(sizes: DataFrame, goal: DataFrame, n: int, most: int) -> DataFrame:
    c = goal.select("src", F.lit(0.0).alias("c"), F.lit(-1).cast("long").alias("settled"))
    done = F.col("c") * F.col("measure") >= most
    while True:
        at = _attach(sizes, c, n)
        sums = at.groupBy("src").agg(F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("sure"), F.sum(F.when(done, F.lit(0)).otherwise(F.col("size") * F.col("measure"))).alias("open"), F.count_if(done).alias("now"), F.first("c").alias("old"))
        nxt = sums.join(goal, "src")
        full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
        value = F.when(full, F.lit(1e18)).when(F.col("open") > 0, (F.col("target") - most * F.col("sure")) / F.col("open")).otherwise(F.col("old"))
        c = written(nxt.select("src", F.greatest("old", value).alias("c"), F.col("now").alias("settled"), (F.col("old") == 0).alias("first")), "mix-scales")
        moved = _attach(sizes, c, n).groupBy("src").agg((F.count_if(done) != F.max("settled")).alias("moved")).where("moved").limit(1).count()
        c = c.drop("first")
        if not moved:
            return c.select("src", "c")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs."""
    return sample(docs, weights, most, seed).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns of docs."""
    names = docs.columns
    own = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in names]).alias("_row")), "mix-rows")
    picks = sample(own.select("row", "_row.doc_id", "_row.text", "_row.source"), weights, most, seed, F.col("row")).where("copies > 0").select("row", "copies")
    got = own.join(picks, "row")
    return got.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
