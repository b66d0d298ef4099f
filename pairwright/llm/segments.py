"""Exact search for repeated windows of symbols, dealt out by minimizers.

A window is `size` consecutive symbols of one text (bytes or words). Its minimizer is the
smallest hash among its k-grams. Equal windows have equal minimizers, so runs of windows
with one minimizer ("segments") that share no minimizer hash with any other segment hold
no repeated window. The remaining segments are collapsed by content, and only one copy of
each content goes to the exact method of the operator (automata or a Burrows-Wheeler
transform), sharded by minimizer. No window is dropped, whatever its frequency.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, lean, mix64, packed, powers, random_table, shuffle_parts, text_bytes, unpack, word_hashes, word_spans, written

#: Windows of one segment at most; longer runs are cut, windows are never lost.
MAX_RUN = 4096
#: Different contents that one task takes under one minimizer.
HOT = 1024
#: Up to so many texts their keys are sent to every task, so that no other text is shuffled for them.
BROADCAST_TEXTS = 200_000
#: Symbols handled at a time in one pass over a batch of texts.
CHUNK = 1 << 19
_BYTE_SYMBOL = random_table(256, 11)


def byte_symbols(raw, off):
    return _BYTE_SYMBOL[raw], off


def word_symbols(raw, off):
    start, end, first = word_spans(raw, off)
    return word_hashes(raw, start, end), first


def _kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each position; the last k-1 entries have no meaning."""
    if len(h) < k:
        return np.zeros_like(h)
    out, have, base = None, 0, np.uint64(0xD6E8FEB86659FD93)
    part, width, mult = h, 1, base
    while True:
        if k & width:
            if out is None:
                out, have = part.copy(), width
            else:
                nxt = np.zeros_like(h)
                nxt[: len(h) - have] = part[have:]
                out = out * mult + nxt
                have += width
        if width * 2 > k:
            return mix64(out)
        nxt = np.zeros_like(h)
        nxt[: len(h) - width] = part[width:]
        part = part * mult + nxt
        width *= 2
        mult = mult * mult


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    m, width = v, 1
    while width * 2 <= w:
        m = np.minimum(m[: len(m) - width], m[width:]) if len(m) > width else m[:0]
        width *= 2
    rest = w - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest and len(m) > rest else m[: max(0, len(m) - rest)]


def segments(h: np.ndarray, first: np.ndarray, size: int, k: int):
    """(text index, start symbol, windows, minimizer hash, content hash, whether the minimizer's
    k-gram stands in it more than once) of every segment."""
    n = len(h)
    lens = np.diff(first)
    if n < size or not (lens >= size).any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    with np.errstate(over="ignore"):
        grams = _kgrams(h, k)
        low = _sliding_min(grams[: n - k + 1], size - k + 1)  # n - size + 1 windows
        text = np.repeat(np.arange(len(lens)), lens)[: n - size + 1]
        at = np.arange(n - size + 1)
        ok = at + size <= first[1:][text]
        cut = ok.copy()
        cut[1:] &= (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], n)
        stop = np.minimum(stop, first[1:][text[start]] - size + 1)
        runs = stop - start
        if (runs > MAX_RUN).any():
            pieces = -(-runs // MAX_RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.repeat(start, pieces) + nth * MAX_RUN
            runs = np.minimum(np.repeat(stop, pieces) - start, MAX_RUN)
        p = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * p[:n], out=total[1:])
        inverse = np.uint64(pow(int(p[1]), -1, 1 << 64))
        back = np.ones(n + 1, np.uint64)
        back[1:] = inverse
        back = np.cumprod(back, dtype=np.uint64)
        width = runs + size - 1
        content = mix64((total[start + width] - total[start]) * back[start] + width.astype(np.uint64))
        again = _again(grams[: n - k + 1], low, start, runs, size - k + 1)
    return text[start], start - first[text[start]], runs, low[start], content, again


def _again(grams, low, start, runs, w):
    """Whether each segment holds its smallest k-gram at two places or more."""
    edge = np.zeros(w - 1, np.uint64)
    top = ~_sliding_min(~np.concatenate([edge, low, edge]), w) if w > 1 else low
    places = np.flatnonzero(top == grams)  # k-grams that are smallest in some window
    value = grams[places]
    lo, hi = np.searchsorted(places, start), np.searchsorted(places, start + runs + w - 1)
    count = hi - lo
    at = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
    same = (value[at] == np.repeat(low[start], count)).astype(np.int64)
    return np.add.reduceat(np.append(same, 0), np.cumsum(count) - count) > 1


def _groups(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about `limit` bytes each."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def segment_rows(docs: DataFrame, symbols: Callable, size: int, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            raw, off = text_bytes(b.column("text"))
            did, rid, weight = (b.column(c).to_numpy(zero_copy_only=False) for c in ("did", "rid", "weight"))
            for i, j in _groups(off, CHUNK * 2):
                h, first = symbols(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                text, start, runs, low, content, again = segments(h, first, size, k)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (did[i + text], rid[i + text], weight[i + text], start.astype(np.int32), runs.astype(np.int32), low.view(np.int64), content.view(np.int64), again)], ["did", "rid", "weight", "start", "runs", "key", "content", "again"])

    return docs.mapInArrow(lean(run), "did long, rid long, weight long, start int, runs int, key long, content long, again boolean")


def grams(size: int, gram: int) -> list[int]:
    """Lengths of the k-grams of the minimizers: the common one, then those for frequent minimizers.

    A window of n k-grams changes its minimizer after about n/2 places, so each level has a sixth of the last one's k-grams
    and gives a few rows for one of it; at the last a window is its own k-gram.
    """
    n, out = size - min(gram, size) + 1, []
    while n > 1:
        out.append(size - n + 1)
        n //= 6
    return [*out, size]


def repeated_windows(docs: DataFrame, symbols: Callable, cut: Callable, size: int, ks: list[int], solve: Callable, tag: str, batch_bytes: int, hot: int = HOT) -> DataFrame:
    """(did, rid, spans): for each text the [start, stop) ranges of its repeated windows.

    docs: did, rid, text and, if a row stands for several, weight. `ks` are the k-gram lengths of `grams`.
    `cut(raw, spans)` gives the bytes of symbol ranges of one text; `solve(contents, weights)`
    gives for each distinct content the ranges of windows that occur twice or more, counted
    with weights.
    """
    if "weight" not in docs.columns:
        docs = docs.withColumn("weight", F.lit(1).cast("long"))
    rows = written(segment_rows(docs.select("did", "rid", "weight", "text"), symbols, size, ks[0]), f"{tag}-segments")
    shared = rows.groupBy("key").agg(F.sum("weight").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("key")
    rows = written(rows.join(shared, "key", "left_semi").drop("again"), f"{tag}-candidates")
    one = F.min(F.struct("did", "rid", "start", "runs")).alias("one")
    distinct = written(rows.groupBy("key", "content").agg(F.sum("weight").alias("weight"), one), f"{tag}-distinct")
    texts = packed(docs)
    frequent = written(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), f"{tag}-frequent") if len(ks) > 1 else None
    verdict = None
    if frequent is not None and frequent.limit(1).count():
        some = written(distinct.join(frequent, "key", "left_semi"), f"{tag}-frequent")
        at = some.select(F.col("one.did").alias("did"), F.col("one.rid").alias("rid")).distinct()
        few = at.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
        held = packed(docs.join(F.broadcast(at), ["did", "rid"], "left_semi")) if few else texts
        bodies = _bodies(held, some, cut, size).dropDuplicates(["key", "content"])
        again = written(bodies.select(F.col("key").alias("did"), F.col("content").alias("rid"), "weight", F.col("data").alias("text")), f"{tag}-anew")
        spans = repeated_windows(again, symbols, cut, size, ks[1:], solve, tag, batch_bytes, hot)
        moved = F.flatten(F.transform("spans", lambda x: F.transform(x["marks"], lambda m: m + x["start"])))
        verdict = written(spans.select(F.col("did").alias("key"), F.col("rid").alias("content"), moved.alias("marks")), f"{tag}-verdict")
        distinct = distinct.join(frequent, "key", "left_anti")
    cold = written(_solved(_bodies(texts, distinct, cut, size), solve, batch_bytes), f"{tag}-verdict")
    verdict = cold if verdict is None else cold.unionByName(verdict)
    hits = rows.join(verdict, ["key", "content"]).select("did", "rid", "start", "marks")
    return hits.groupBy("did", "rid").agg(F.collect_set(F.struct("start", "marks")).alias("spans"))


def _bodies(texts: DataFrame, distinct: DataFrame, cut: Callable, size: int) -> DataFrame:
    """(key, content, weight, data): the symbols of each distinct content, cut out of one text that holds it."""
    wanted = distinct.groupBy(F.col("one.did").alias("did"), F.col("one.rid").alias("rid")).agg(
        F.collect_list(F.struct(F.col("one.start").alias("start"), F.col("one.runs").alias("runs"), "key", "content", "weight")).alias("parts")
    )

    def contents(batches):
        for b in batches:
            z, parts = b.column("z").to_numpy(zero_copy_only=False), b.column("parts")
            off, flat = parts.offsets.to_numpy(), parts.flatten()
            cols = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "runs", "key", "content", "weight")}
            base = off[0]
            for lo in range(0, len(z), 64):
                hi = min(len(z), lo + 64)
                at = slice(off[lo] - base, off[hi] - base)
                data = []
                for i in range(lo, hi):
                    s = slice(off[i] - base, off[i + 1] - base)
                    data += cut(unpack(z[i]), cols["start"][s], cols["runs"][s] + size - 1)
                yield pa.RecordBatch.from_arrays([pa.array(cols["key"][at]), pa.array(cols["content"][at]), pa.array(cols["weight"][at]), pa.array(data, pa.binary())], ["key", "content", "weight", "data"])

    return texts.join(wanted, ["did", "rid"]).select("z", "parts").mapInArrow(lean(contents), "key long, content long, weight long, data binary")


def _solved(bodies: DataFrame, solve: Callable, batch_bytes: int) -> DataFrame:
    """(key, content, marks) of the contents with repeated windows; whole keys are solved together."""
    parts = shuffle_parts(bodies.sparkSession) * 2
    dealt = bodies.repartition(parts, "key").sortWithinPartitions("key", "content")

    def solved(batches):
        def flush(pend):
            keys = [x[1] for x in pend]
            marks = solve([x[3] for x in pend], np.array([x[2] for x in pend], np.int64))
            good = [i for i, m in enumerate(marks) if len(m)]
            return pa.RecordBatch.from_arrays([pa.array([pend[i][0] for i in good], pa.int64()), pa.array([keys[i] for i in good], pa.int64()), pa.array([np.asarray(marks[i], np.int32).ravel() for i in good], pa.list_(pa.int32()))], ["key", "content", "marks"])

        pend, held, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("key", "content", "weight", "data")), strict=True):
                if last is not None and row[0] != last[0] and held >= batch_bytes:
                    yield flush(pend)
                    pend, held = [], 0
                if last is not None and row[:2] == last[:2]:
                    continue  # the chosen text stands in the input more than once
                pend.append(row)
                held += len(row[3])
                last = row
        if pend:
            yield flush(pend)

    return dealt.mapInArrow(lean(solved), "key long, content long, marks array<int>")


def merged(spans: list[dict], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered symbol ranges from window ranges: starts and ends, in order."""
    a = np.concatenate([np.asarray(s["marks"], np.int64).reshape(-1, 2) + s["start"] for s in spans])
    a = a[np.argsort(a[:, 0], kind="stable")]
    start, end = a[:, 0], np.maximum.accumulate(a[:, 1] + size - 1)
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def whole_texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, z, spans): every input row with the repeated windows of its text, null if none."""
    return packed(docs).join(spans, ["did", "rid"], "left").select("id", "z", "spans")


__all__ = ["byte_symbols", "word_symbols", "segments", "grams", "repeated_windows", "merged", "whole_texts", "keyed"]
