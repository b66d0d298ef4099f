"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Removes each byte covered by a string of `size` bytes that also starts anywhere else.

Cases: a null or empty text, or one shorter than `size`, loses nothing; a very long text is
searched whole; rows that repeat (same or other ids) are each other's copies; extra columns are ignored; an empty table gives
an empty result. Strings never cross texts. Removing bytes may leave a UTF-8 sequence
incomplete, so kept bytes are returned as binary by `dedup(..., keep_bytes=True)`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, lean, unpack
from .segments import HOT, byte_symbols, grams, merged, repeated_windows, whole_texts

SIZE = 400
#: Bytes of the k-grams whose smallest hash deals out the windows.
GRAM = 32
#: Bytes of distinct candidate strings in one transform.
BATCH = 1 << 20


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of t sorted by their next `depth` symbols (prefix doubling); 9-bit symbols."""
    n = len(t)
    key = np.zeros(n, np.int64)
    wide = t.astype(np.int64)
    for i in range(7):
        key <<= 9
        key[: n - i] |= wide[i:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.append(True, s[1:] != s[:-1])
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    h = 7
    tied = ~(new & np.append(new[1:], True))
    while h < depth and tied.any():
        slots = np.flatnonzero(tied)
        pos = order[slots]
        nxt = pos + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        first = rank[pos]
        by = np.argsort(first * (n + 2) + second, kind="stable")
        pos, first, second = pos[by], first[by], second[by]
        order[slots] = pos
        fresh = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        heads = np.flatnonzero(fresh)
        rank[pos] = np.repeat(slots[heads], np.diff(np.append(heads, len(pos))))
        alone = fresh & np.append(fresh[1:], True)
        tied[slots[alone]] = False
        h *= 2
    return order


def long_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """True at i if the suffixes order[i-1] and order[i] share `depth` symbols or more.

    Breadth-first backward extension on the transform: the intervals of all strings of one
    length are extended by every preceding symbol at once; an interval that ends where no
    common prefix is known yet gives it, so the values come by increasing length, and an
    interval that teaches nothing is not extended. After `depth` rounds what is still
    unknown is at least `depth`.
    """
    n = len(t)
    bwt = t[order - 1]  # order holds 0; t[-1] is the last separator
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    f = bwt[by]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    edge = np.flatnonzero(f[1:] != f[:-1]) + 1
    known[edge] = True
    lo, hi = np.append(0, edge), np.append(edge, n)
    owner = np.empty(n, np.int64)
    for _ in range(depth - 1):
        size = hi - lo
        if not len(size):
            break
        total = int(size.sum())
        ident = np.repeat(np.arange(len(size)), size)
        p = np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)
        q = lf[p]
        owner[q] = ident
        if total * 8 > n:
            mark = np.zeros(n, bool)
            mark[q] = True
            q = np.flatnonzero(mark)
        else:
            q = np.sort(q)
        own, ch = owner[q], f[q]
        new = np.append(True, (q[1:] != q[:-1] + 1) | (own[1:] != own[:-1]) | (ch[1:] != ch[:-1]))
        head = np.flatnonzero(new)
        lo, hi = q[head], q[np.append(head[1:] - 1, len(q) - 1)] + 1
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        known[hi] = True
    return ~known[:n]


def repeated(contents: list[bytes], weights: np.ndarray, size: int) -> list[np.ndarray]:
    """For each string the [start, stop) ranges of its windows that occur twice or more."""
    lens = np.array([len(c) for c in contents], np.int64)
    step = lens + 1
    ends = np.cumsum(step)
    t = np.zeros(int(ends[-1]), np.uint16)
    t[:] = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    t += 1
    t[ends - 1] = 0
    order = suffix_order(t, size)
    joined = long_prefixes(t, order, size)
    owner = np.repeat(np.arange(len(lens)), step)
    head = np.flatnonzero(~joined)
    spread = np.diff(np.append(head, len(order)))
    heavy = np.add.reduceat(weights[owner[order]], head) > 1
    hit = np.zeros(len(t), bool)
    hit[order] = np.repeat(heavy, spread)
    hit &= np.arange(len(t)) + size <= (ends - 1)[owner]
    flips = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    ranges = flips.reshape(-1, 2)
    which = owner[ranges[:, 0]] if len(ranges) else np.zeros(0, np.int64)
    begin = ends - step
    at = np.searchsorted(which, np.arange(len(lens) + 1))
    return [ranges[at[i] : at[i + 1]] - begin[i] for i in range(len(lens))]


def _cut(raw: bytes, start, width) -> list[bytes]:
    return [raw[s : s + w] for s, w in zip(start.tolist(), width.tolist(), strict=True)]


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of docs."""
    rows = keyed(docs, id_col, text_col)
    spans = repeated_windows(rows, byte_symbols, _cut, size, grams(size, gram), lambda c, w: repeated(c, w, size), "op4", BATCH, hot)

    def finish(batches):
        for b in batches:
            out = []
            for doc, z, marks in zip(b.column("id").to_pylist(), b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = unpack(z)
                gone = n = 0
                kept = raw
                if marks:
                    start, end = merged(marks, size)
                    n, gone = len(start), int((end - start).sum())
                    kept = b"".join(raw[a:z] for a, z in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
                out.append((doc, len(raw), gone, n, hashlib.sha256(kept).hexdigest(), *([kept] if keep_bytes else [])))
            cols = list(zip(*out, strict=True)) or [[]] * (5 + keep_bytes)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_bytes
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_bytes])

    return whole_texts(rows, spans).mapInArrow(lean(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
