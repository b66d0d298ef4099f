"""Spelling variants by forward and reversed sorted dictionaries.

Two words are near if one code point is inserted, deleted or replaced. Let the longer have N code
points and let p be the first place at which they differ, counted from 0 (N - 1 at most). A block is
a range lo <= p < hi with the N-words and (N-1)-words that share their first lo code points and their
last N - hi. At first the range is halved: its right half is a run of equal prefixes in the sorted
dictionary, its left half a run of equal suffixes in the dictionary sorted from the end. Blocks of
more than `HOT` words are halved on, until a range has one place and a block no more words than the
alphabet has letters. Every near pair is in exactly one block, which is where it is verified, so a
block yields a count and the best partner for each of its words, and no list of pairs is made.

Cases: null texts have no words; a null doc_id counts as `null` in the hash; texts may be of any
length; rows that repeat count each time; ties of n are decided by code points; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shuffle_parts, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
NOISE, LEAST_LENGTH, LEAST_N, RATIO = 97, 5, 3, 2
#: Words of a block that are compared with each other without halving its range.
HOT = 128
#: Different words that a task counts before it hands them on; texts above LONG bytes are not split into a list.
HELD, LONG = 400_000, 1 << 20
#: Cells (code points of pairs) compared at a time; rows and bytes of blocks taken together.
CELLS, ROWS, BYTES = 1 << 22, 1 << 14, 1 << 22
BLOCK = ["n_long", "lo", "hi", "pre", "suf"]


def doc_words(doc_id, raw: bytes) -> Counter:
    """Words of one text with their counts, after the noise that a hash of document and run decides."""
    text = raw.translate(LOWER).decode()
    runs = Counter(RUN.findall(text) if len(raw) < LONG else (m[0] for m in RUN.finditer(text)))
    start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for w, n in runs.items():
        h = zlib.crc32(w.encode(), start)
        if h % NOISE == 0:
            h %= len(w)
            w = w[:h] + w[h + 1 :]
        if len(w) >= LEAST_LENGTH:
            out[w] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of all words of at least LEAST_LENGTH code points and LEAST_N occurrences."""

    def run(batches):
        held: Counter = Counter()
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for b in batches:
            for i, z in zip(b.column("doc_id").to_pylist(), b.column("z"), strict=True):
                for w, n in doc_words(i, z.as_py()).items():
                    held[w] += n
                if len(held) >= HELD:
                    yield batch()
                    held = Counter()
        if held:
            yield batch()

    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("z")).mapInArrow(lean(run), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def _keyed(df: DataFrame) -> DataFrame:
    """df (word, n, n_long, lo, hi) with the prefix and suffix that name its block."""
    tail = F.col("n_long") - F.col("hi")
    pre = F.expr("substring(word, 1, lo)")
    suf = F.when(tail > 0, F.expr("right(word, n_long - hi)")).otherwise("")
    return df.select("word", "n", "n_long", "lo", "hi", pre.alias("pre"), suf.alias("suf"))


def _halves(df: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    return _keyed(df.select("word", "n", "n_long", F.inline(parts)))


def blocks(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Every word in the blocks it belongs to: word, n, n_long, lo, hi, pre, suf."""
    size = F.length("word")
    both = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("n_long"), F.lit(0).alias("lo")).withColumn("hi", F.col("n_long"))
    now, out = written(_halves(both), "variants-blocks"), None
    while True:
        large = now.where("hi - lo > 1").groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot).drop("rows")
        large = written(large, "variants-large")
        if large.isEmpty():
            return now if out is None else out.unionByName(now)
        fine = now.join(large, BLOCK, "left_anti").select(now.columns)
        out = fine if out is None else out.unionByName(fine)
        now = written(_halves(now.join(large, BLOCK, "left_semi")), "variants-blocks")


def _matches(rest: np.ndarray, size: np.ndarray, longer: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which rows i and j of a block are near, with their first difference in the block's range.

    rest: code points of the range, padded with 0; size: places of the range. At most one of i and j is the shorter."""
    width = rest.shape[1]
    a, b = np.where(longer[i], j, i), np.where(longer[i], i, j)  # a: the shorter, if one is
    x, y = rest[a], rest[b]
    same = x == y
    replaced = (~same).sum(1) == 1
    lead = np.logical_and.accumulate(same, axis=1)
    shifted = np.ones_like(same)
    shifted[:, : width - 1] = x[:, :-1] == y[:, 1:]
    shifted |= np.arange(width) >= (size[b] - 1)[:, None]
    inserted = (lead | shifted).all(1) & ~lead[np.arange(len(b)), size[b] - 1]
    return np.where(longer[a], replaced, inserted)


def near(rows: DataFrame) -> DataFrame:
    """(word, n_near, best): near words within each block, best = (-n, word) of the first by n and code points."""
    parts = shuffle_parts(rows.sparkSession) * 2
    order = [*BLOCK, F.desc("n"), "word"]
    dealt = rows.repartitionByRange(parts, *BLOCK).sortWithinPartitions(*order)
    dealt = dealt.select("word", "n", *BLOCK, (F.length("word") == F.col("n_long")).alias("longer"), F.expr("substring(word, lo + 1, hi - lo)").alias("rest"))

    def verified(t: pa.Table, first: np.ndarray):
        """t: whole blocks, from the rows `first`."""
        rest, n = t.column("rest").to_numpy(), t.num_rows
        size = t.column("hi").to_numpy().astype(np.int64) - t.column("lo").to_numpy()
        longer = t.column("longer").to_numpy()
        width = int(size.max())
        codes = np.array(rest.tolist(), f"<U{width}").view(np.uint32).reshape(n, width)
        stop = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
        pairs = stop - np.arange(n) - 1  # each row with those after it
        total = np.append(0, np.cumsum(pairs))
        count, best = np.zeros(n, np.int64), np.full(n, n)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + max(1, CELLS // width), "right")) - 1)
            i = np.repeat(np.arange(lo, hi), pairs[lo:hi])
            j = np.arange(total[lo], total[hi]) - np.repeat(total[lo:hi], pairs[lo:hi]) + i + 1
            some = longer[i] | longer[j]
            i, j = i[some], j[some]
            good = _matches(codes, size, longer, i, j)
            i, j = i[good], j[good]
            count += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            np.minimum.at(best, i, j)
            np.minimum.at(best, j, i)
            lo = hi
        at = np.flatnonzero(count)
        word = t.column("word").combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(at)), pa.array(count[at]), pa.array(t.column("n").to_numpy()[best[at]]), word.take(pa.array(best[at]))], ["word", "n_near", "best_n", "best"])

    def run(batches):
        pend = None
        for b in batches:
            t = pa.Table.from_batches([b])
            pend = t if pend is None else pa.concat_tables([pend, t])
            if pend.num_rows < ROWS and pend.nbytes < BYTES:
                continue
            first = starts(pend)
            if len(first) > 1:  # the last block may go on
                yield verified(pend.slice(0, first[-1]), first[:-1])
                pend = pend.slice(first[-1]).combine_chunks()
        if pend is not None and pend.num_rows:
            yield verified(pend, starts(pend))

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in BLOCK:
            v = t.column(c)
            new[1:] |= pc.not_equal(v.slice(1), v.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False) if t.num_rows > 1 else False
        return np.flatnonzero(new)

    found = dealt.mapInArrow(lean(run), "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form; forms: word, form. Counts double along forms, so chains are short, and are halved by each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = written(step, "variants-roots")
        if step.where("moved").isEmpty():
            return step.drop("moved")
        now = step.drop("moved")


def variants(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = written(vocabulary(docs), "variants-words")
    found = words.join(near(blocks(words, hot)), "word", "left")
    taken = -F.col("best.minus") >= RATIO * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"))
    found = written(found, "variants-found")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
