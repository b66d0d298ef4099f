"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII characters, ASCII letters in lower case. The
document frequency of every n-gram of the test items is counted over all documents; those that
stand in one are seeds, and the rarest half of an item's seeds are rare. A passage that holds a
rare seed is aligned with the item; one that holds frequent seeds alone is aligned if its words
allow the least score. The score is the best local alignment over that of the item with itself.
So every passage that shares an n-gram and reaches the least score is found. An item of fewer than
`gram` words is a seed as a whole: it is found where its words stand in a row.

Test items are sent to the tasks in blocks of at most `BLOCK_BYTES` (an item beyond that is a
block of its own); each block is counted and searched in all documents, two scans a block, so a
benchmark of any size is searched whole.

Cases: null and empty texts match nothing, nor do items without a word; a very long text is
searched whole; items with equal texts each match, but rows of the benchmark that repeat with
their id are one item; documents that repeat each match; empty tables give empty results; `clean` keeps the columns of its input, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, lean, text_bytes, word_hashes
from .segments import _groups, _kgrams

GRAM = 3
#: Share of the item's own score from which a passage is a copy.
LEAST = 0.5
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, 1, 1
RESULT = "doc_id long, item_id long, score double, first_word long, last_word long"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each text (len(texts)+1)."""
    solid = _SOLID[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return word_hashes(_FOLD[raw], start, end), np.searchsorted(start, off)


def _text_tokens(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return tokens(raw, np.array([0, len(raw)]))[0]


class Lookup:
    """Places of n-grams of documents among the known ones."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams  # sorted
        self.bits = max(16, int(len(grams)).bit_length() + 6)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[grams >> np.uint64(64 - self.bits)] = True

    def find(self, h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word number and number of the n-gram of every hit; n-grams do not cross texts."""
        if len(h) < n or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            g = _kgrams(h, n)[: len(h) - n + 1]
        at = np.flatnonzero(self.seen[g >> np.uint64(64 - self.bits)])
        k = np.searchsorted(self.grams, g[at])
        k[k == len(self.grams)] = 0
        ok = self.grams[k] == g[at]
        at, k = at[ok], k[ok]
        ok = at + n <= first[1:][np.searchsorted(first, at, "right") - 1]
        return at[ok], k[ok]


class Items:
    """Test items of a block: their words and n-grams. With whole, those of just `gram` words, which are seeds as a whole."""

    def __init__(self, rows: list[tuple[int | None, str | None]], gram: int, whole: bool = False):
        self.gram = gram
        self.ids, self.words, sets = [], [], []
        for item, text in rows:
            w = _text_tokens(text)
            if len(w) == gram if whole else len(w) >= gram:
                with np.errstate(over="ignore"):
                    g = _kgrams(w, gram)[: len(w) - gram + 1]
                self.ids.append(item)
                self.words.append(w)
                sets.append(g)
        n = np.array([len(g) for g in sets], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        self.grams = np.unique(flat)
        #: item, place in it and n-gram of every n-gram of the items; until seeds are taken
        self.entries = np.column_stack([np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), np.searchsorted(self.grams, flat)])

    def seeds(self, df: np.ndarray) -> None:
        """Take every n-gram that stands in a document as a seed; the rarest half of each item's, ties included, are rare."""
        e, self.entries = self.entries[df[self.entries[:, 2]] > 0], None
        n = df[e[:, 2]]
        ranked = n[np.lexsort((n, e[:, 0]))]  # item by item, as the entries are
        head = np.searchsorted(e[:, 0], np.arange(len(self.ids) + 1))
        middle = head[:-1] + (np.diff(head) - 1) // 2
        limit = np.append(ranked, 0)[np.maximum(middle, 0)]
        rare = n <= limit[e[:, 0]]
        by = np.argsort(e[:, 2], kind="stable")
        e, self.rare = e[by], rare[by]
        used = np.unique(e[:, 2])
        self.lookup = Lookup(self.grams[used])
        self.of, self.place = e[:, 0], e[:, 1]
        self.begin = np.append(np.searchsorted(e[:, 2], used), len(e))
        self.vocab = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *(i * len(self.vocab) + np.searchsorted(self.vocab, w) for i, w in enumerate(self.words))]))

    def bounds(self, h: np.ndarray, a: np.ndarray, z: np.ndarray, item: np.ndarray) -> np.ndarray:
        """What the alignment of each passage h[a:z] with its item can score at most.

        A word of the item gives at most a match, any other costs a mismatch or a gap: the best run of such values.
        """
        out = np.zeros(len(a), np.int64)
        off = np.append(0, np.cumsum(z - a))
        for i, j in _groups(off, STEP):
            n = (z - a)[i:j]
            start = off[i:j] - off[i]
            word = h[np.arange(n.sum()) + np.repeat(a[i:j] - start, n)]
            k = np.searchsorted(self.vocab, word)
            k[k == len(self.vocab)] = 0
            key = np.repeat(item[i:j], n) * len(self.vocab) + k
            at = np.searchsorted(self.known, key)
            at[at == len(self.known)] = 0
            value = np.where((self.vocab[k] == word) & (self.known[at] == key), MATCH, -min(MISMATCH, GAP))
            total = np.cumsum(value)
            # passages lie so far below each other that no minimum is one of an earlier passage
            total -= np.repeat(np.arange(j - i) * ((MATCH + 1) * (len(word) + 1)), n)
            out[i:j] = np.maximum.reduceat(total - np.minimum.accumulate(total - value), start)
        return out

    def matches(self, raw: np.ndarray, off: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, last word) of every item that a text holds."""
        h, first = tokens(raw, off)
        at, k = self.lookup.find(h, first, self.gram)
        if not len(at):
            return []
        n = self.begin[k + 1] - self.begin[k]
        e = np.arange(n.sum()) + np.repeat(self.begin[k] - (np.cumsum(n) - n), n)
        item, rare, at = self.of[e], self.rare[e], np.repeat(at, n)
        text = np.searchsorted(first, at, "right") - 1
        lead = at - self.place[e]
        by = np.lexsort((lead, item, text))
        text, item, lead, rare = text[by], item[by], lead[by], rare[by]
        size = np.array([len(w) for w in self.words])[item]
        new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (lead[1:] - lead[:-1] > size[1:]))
        head = np.flatnonzero(new)
        tail = np.append(head[1:] - 1, len(lead) - 1)
        # an alignment that scores `least` has no more gaps
        slack = np.ceil((1 - least) * MATCH / GAP * size[head]).astype(np.int64) + 1
        a = np.maximum(first[text[head]], lead[head] - slack)
        z = np.minimum(first[text[head] + 1], lead[tail] + size[head] + slack)
        # passages with a rare seed are aligned; those with frequent ones only where `least` can be reached
        reach = np.logical_or.reduceat(rare, head)
        weak = np.flatnonzero(~reach)
        reach[weak] = self.bounds(h, a[weak], z[weak], item[head[weak]]) >= least * MATCH * size[head[weak]]
        out = {}
        order = np.flatnonzero(reach)
        order = order[np.argsort((z - a)[order], kind="stable")]
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and j - i < 256 and (j - i + 1) * int(z[order[j]] - a[order[j]]) <= 1 << 19:
                j += 1
            some = order[i:j]
            best, end, begin = align([h[a[s] : z[s]] for s in some], [self.words[item[head[s]]] for s in some])
            for s, b, p, q in zip(some, best, begin, end, strict=True):
                key, score = (int(text[head[s]]), int(item[head[s]])), float(b) / (MATCH * int(size[head[s]]))
                if score >= least and score > out.get(key, (0,))[0]:
                    base = int(a[s] - first[key[0]])
                    out[key] = (score, base + int(p), base + int(q))
            i = j
        return [(t, i, *v) for (t, i), v in out.items()]


def align(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of every pair, and the last and first word of that alignment.

    Gaps cost the same for each word, so the best gap into a cell is a running maximum.
    """
    c, w, rows = len(texts), max(map(len, texts)), max(map(len, items))
    t, q = np.zeros((c, w), np.uint64), np.zeros((c, rows), np.uint64)
    for i in range(c):
        t[i, : len(texts[i])], q[i, : len(items[i])] = texts[i], items[i]
    width, depth = np.array([len(x) for x in texts]), np.array([len(x) for x in items])
    inside = np.arange(w) < width[:, None]
    # a cell holds score * span - start, so that of equal scores the earliest start is best;
    # a cell with no alignment starts one at the next word
    span = np.int64(1 << 32)
    slope = np.arange(w, dtype=np.int64) * (GAP * span)
    none = np.broadcast_to(-np.arange(1, w + 1, dtype=np.int64), (c, w))
    above = none.copy()
    top, where = np.zeros(c, np.int64), np.zeros(c, np.int64)
    for r in range(rows):
        same = (t == q[:, r : r + 1]) & inside & (r < depth)[:, None]
        diag = np.concatenate([np.zeros((c, 1), np.int64), above[:, :-1]], 1)
        cell = np.maximum(diag + np.where(same, MATCH, -MISMATCH) * span, above - GAP * span)
        cell = np.maximum.accumulate(cell + slope, 1) - slope
        cell = np.where(cell > 0, cell, none)
        above = cell
        best = cell.argmax(1)
        value = cell[np.arange(c), best]
        better = value > top
        top[better], where[better] = value[better], best[better]
    score = -(-top // span)
    begin = score * span - top
    return score, where, begin


def _blocks(benchmark: DataFrame, gram: int, block_bytes: int) -> Iterator[list[Items]]:
    """Items in blocks of bounded size, read one block at a time; in a block the short items of each length are apart."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = F.octet_length("text") + 64
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    # a hundred hash cells for each block: few rows reach the driver, and blocks can be filled up to their size
    cells = 100 * max(1, -(-total // block_bytes)) if total > block_bytes else 1
    items = items.withColumn("cell", F.pmod(F.xxhash64("item_id", "text"), F.lit(cells)))
    blocks, held = [[]], 0
    for cell, n in sorted(map(tuple, items.groupBy("cell").agg(F.sum(size)).collect())):
        if held and held + n > block_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append(cell)
        held += n
    for cells_ in blocks:
        rows = items.where(F.col("cell").between(cells_[0], cells_[-1])) if cells_ else items
        rows = [tuple(r) for r in rows.select("item_id", "text").collect()]
        yield [x for x in (Items(rows, gram), *(Items(rows, n, whole=True) for n in range(1, gram))) if x.ids]


def _texts(batch, name):
    col = batch.column(name).cast(pa.string())
    return text_bytes(pa.array(col).fill_null("") if col.null_count else col)


def _ready(docs: DataFrame, block: list[Items], text_col: str) -> None:
    """Count the documents with each n-gram of the block, over all documents; choose seeds."""
    looks = [(k, Lookup(x.grams), x.gram, len(x.grams)) for k, x in enumerate(block)]

    def count(batches):
        totals = [np.zeros(size, np.int64) for *_, size in looks]
        for b in batches:
            raw, off = _texts(b, "text")
            for i, j in _groups(off, STEP):
                h, first = tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                for part, look, n, size in looks:
                    at, k = look.find(h, first, n)
                    text = np.searchsorted(first, at, "right") - 1
                    totals[part] += np.bincount(np.unique(text * size + k) % size, minlength=size)
        for part, total in enumerate(totals):
            k = np.flatnonzero(total)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), part)), pa.array(k), pa.array(total[k])], ["part", "gram", "n"])

    df = [np.zeros(len(x.grams), np.int64) for x in block]
    if block:
        # at most one row for each n-gram of the block reaches the driver
        for part, g, m in docs.select(F.col(text_col).alias("text")).mapInArrow(lean(count), "part long, gram long, n long").groupBy("part", "gram").agg(F.sum("n")).collect():
            df[part][g] = m
    for x, d in zip(block, df, strict=True):
        x.seeds(d)


def find(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """RESULT's columns for every document and test item of which it holds a copy."""
    out = None
    for block in _blocks(benchmark, gram, block_bytes):
        _ready(docs, block, "text")

        def run(batches, block=block):
            for b in batches:
                raw, off = _texts(b, "text")
                ids = b.column("doc_id").to_pylist()
                for i, j in _groups(off, STEP):
                    hits = [(ids[i + t], x.ids[k], s, p, q) for x in block for t, k, s, p, q in x.matches(raw[off[i] : off[j]], off[i : j + 1] - off[i], least)]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hits, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "first_word", "last_word"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(lean(run), RESULT)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents that hold a copy of a test item; nothing is shuffled."""
    out = docs
    at = docs.columns.index("text")
    for block in _blocks(benchmark, gram, block_bytes):
        _ready(docs, block, "text")

        def run(batches, block=block):
            for b in batches:
                raw, off = _texts(b, at)
                keep = np.ones(len(off) - 1, bool)
                for i, j in _groups(off, STEP):
                    for x in block:
                        for t, *_ in x.matches(raw[off[i] : off[j]], off[i : j + 1] - off[i], least):
                            keep[i + t] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
