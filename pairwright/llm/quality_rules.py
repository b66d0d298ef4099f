"""Quality rules with adaptive thresholds, DataFrame functions only.

Base rules are fixed (too few words, too many words in repeated windows). Beyond them each
measure of a document is held against fences of its own language and source, taken from
mergeable quantile sketches over all documents that pass the base rules. The quartiles of a
language and source are blended with its language's, and those with the quartiles of all, by
counts: what lies above weighs as much as `prior` documents. A fence is `reach` interquartile ranges, and at least the
measure's slack, beyond the quartile, so a group in which everything is alike rejects nothing.

A sketch is a histogram of high dynamic range: values keep their `DIGITS` leading binary
digits, and a bin its count. Sketches merge by adding counts, so the quartiles, true to
one part in 2**(DIGITS - 1), are the same however the rows are dealt out.

Cases: a null or empty text has no words and fails the base rules; null languages or sources
are groups of their own; a very long text is measured whole; rows that repeat each count and get
the same verdict; an empty table gives an empty result; extra columns are ignored by `measure`
and `judge` keeps them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WINDOW = 8
#: Measure: (lower fence wanted, slack). Ratios are rounded so that any engine gives the same.
MEASURES = {"symbol_ratio": (False, 0.05), "word_length": (True, 1.5), "dup_line_ratio": (False, 0.3), "repeat_ratio": (False, 0.1)}
REACH = 3.0
#: Documents that the quartiles of the coarser group weigh as much as.
PRIOR = 4
#: Leading binary digits that a sketch keeps of a value in millionths.
DIGITS = 11
BROADCAST_ROWS = 50_000


def _tail(array: Column, skip: int) -> Column:
    return F.slice(array, F.lit(skip + 1), F.greatest(F.lit(0), F.size(array) - skip))


def _doubled(array: Column, by: int) -> Column:
    """Hashes of windows twice as long as those in array, which hold `by` words."""
    n = F.greatest(F.lit(0), F.size(array) - by)
    return F.zip_with(F.slice(array, F.lit(1), n), _tail(array, by), lambda a, b: F.xxhash64(a, b))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base measures of every row."""
    df = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("lines", lines)
    df = df.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    for by in (1, 2, 4):
        df = df.withColumn(f"h{2 * by}", _doubled(F.col(f"h{by}"), by)).drop(f"h{by}")
    # positions of windows that occur twice, from hashes sorted with their places; most texts have none
    ordered = F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("s", ordered).drop("h8")
    s, n = F.col("s"), F.size("s")
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, F.lit(1), n - 1))
    df = df.withColumn("t", F.arrays_zip(s.alias("x"), before.alias("a"), F.concat(_tail(s, 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("b")))
    again = F.filter("t", lambda e: F.coalesce(e["x"]["h"] == e["a"]["h"], F.lit(False)) | F.coalesce(e["x"]["h"] == e["b"]["h"], F.lit(False)))
    df = df.withColumn("at", F.sort_array(F.transform(again, lambda e: e["x"]["i"]))).drop("s", "t")
    gaps = F.zip_with("at", _tail(F.col("at"), 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    df = df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("at")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6), F.lit(0.0))


def _key(lang: Column, source: Column) -> Column:
    """Groups by null-safe equality: a null differs from every string."""
    part = lambda c: F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.char_length(c).cast("string"), F.lit(":"), c))
    return F.concat(part(lang), F.lit("/"), part(source))


def binned(value: Column, digits: int = DIGITS) -> Column:
    """Lower end, in millionths, of the bin that a value of six decimals falls in."""
    v = F.round(value * 1_000_000).cast("long")
    off = F.greatest(F.lit(0), F.length(F.bin(v)) - digits)
    return F.call_function("shiftleft", F.call_function("shiftright", v, off), off)


def _quartiles(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """keys, count and quartiles of every measure from bin counts; a sketch has few bins."""
    bins = sketch.groupBy(*keys, "m", "bin").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "m")
    bins = bins.withColumn("run", F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(of))
    cut = bins.groupBy(*keys, "m").agg(F.max("all").alias("n"), *[F.min(F.when(4 * F.col("run") >= q * F.col("all"), F.col("bin"))).alias(f"q{q}") for q in (1, 3)])
    wide = [F.max(F.when(F.col("m") == i, F.col(f"q{q}"))).cast("double") / 1_000_000 for i in range(len(MEASURES)) for q in (1, 3)]
    names = [f"{prefix}_{m}_q{q}" for m in MEASURES for q in (1, 3)]
    return cut.groupBy(*[F.col(k).alias(f"{prefix}_{k}") for k in keys]).agg(F.max("n").alias(f"{prefix}_n"), *[c.alias(x) for c, x in zip(wide, names, strict=True)])


def fences(rows: DataFrame, prior: int = PRIOR, reach: float = REACH) -> DataFrame:
    """group and the lower and upper fence of every measure."""
    values = F.array(*[F.struct(F.lit(i).alias("m"), binned(F.col(m)).alias("bin")) for i, m in enumerate(MEASURES)])
    good = rows.where("not base_failed").select("group", "lang", F.explode(values).alias("x")).select("group", "lang", "x.m", "x.bin")
    sketch = written(good.groupBy("group", "lang", "m", "bin").agg(F.count(F.lit(1)).alias("n")), "rules-sketches")
    groups = rows.select("group", "lang").distinct()
    x = groups.join(_quartiles(sketch, ["group"], "o"), F.col("group") == F.col("o_group"), "left")
    x = x.join(F.broadcast(_quartiles(sketch, [], "a")), F.lit(True), "left")  # one row
    x = x.join(_quartiles(sketch, ["lang"], "t"), F.col("lang").eqNullSafe(F.col("t_lang")), "left")
    out = [F.col("group")]
    blend = lambda p, m, above: (F.coalesce(f"{p}_n", F.lit(0)) * F.coalesce(m, F.lit(0.0)) + prior * above) / (F.coalesce(f"{p}_n", F.lit(0)) + prior)
    for m, (_, slack) in MEASURES.items():
        lo, hi = (blend("o", f"o_{m}_q{q}", blend("t", f"t_{m}_q{q}", F.col(f"a_{m}_q{q}"))) for q in (1, 3))
        width = F.greatest(F.lit(slack), reach * (hi - lo))
        out += [(lo - width).alias(f"{m}_low"), (hi + width).alias(f"{m}_high")]
    return x.select(*out)


def judge(docs: DataFrame, prior: int = PRIOR, reach: float = REACH) -> DataFrame:
    """Base measures, base_failed and kept for every row of docs."""
    rows = measure(docs).withColumn("group", _key(F.col("lang"), F.col("source")))
    values = {"symbol_ratio": _ratio("n_symbols", "word_chars"), "word_length": _ratio("word_chars", "n_words"), "dup_line_ratio": _ratio("n_dup_lines", "n_lines"), "repeat_ratio": _ratio("n_repeat_words", "n_words")}
    rows = written(rows.withColumns(values), "rules-rows")
    limits = written(fences(rows, prior, reach), "rules-fences")
    n = limits.count()
    joined = rows.join(F.broadcast(limits) if n <= BROADCAST_ROWS else limits, "group", "left")
    fine = ~F.col("base_failed")
    for m, (both, _) in MEASURES.items():
        fine = fine & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        if both:
            fine = fine & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", fine.alias("kept"), "symbol_ratio", "word_length", "dup_line_ratio", "repeat_ratio")
