"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Terms are pairs of neighbouring character classes (bytes beyond ASCII by themselves, so that
every script has its own), words that repeat soon and word pairs that stood in the text before.
Their document frequencies are counted over all documents; labelled documents (a bounded sample,
`SAMPLE` rows) give a truncated singular value decomposition. Their latent vectors are
broadcast, every document's cosine with every one of them is computed exactly in blocks, and
the labels of the `K` nearest vote with their similarity; those that tie at the last place share
its votes.

Weights were chosen on labelled rows whose remainder is 1, with a model of those with 0 and 3;
rows that are held out had no part in it. Scores are rounded to six decimals.

Cases: a text without terms (null, empty, one character) gets the share of label 1 in the
sample; a very long text is counted whole; without any labels the score is 0.5; a null id is not
held out and never labelled; rows that repeat each get the same score; an id labelled more than
once counts once, with its largest label; of an id's different texts the one with the smallest
digest is learned from; labels without a document take no place in the sample; an empty table
gives an empty result; extra columns are ignored by `score` and kept by `accepted`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, lean, mix64, text_bytes, word_hashes, word_spans
from .segments import _groups

#: Labelled rows that the space is fitted on, at most.
SAMPLE = 4096
DIMS = 64
K = 15
#: Votes are weighted with this power of the similarity.
POWER = 4
KEEP = 0.7
CHUNK = STEP
#: Texts whose terms are counted at a time: a matrix of these by TERMS.
ROWS = 128
#: Labels looked up among the documents at once are broadcast up to this number.
LOOKUP = 1 << 20

# lower-case letters, one class for capitals, digits, each other sign its own; beyond ASCII the byte
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = 27
_CLASS[48:58] = 28
_others = [b for b in range(128) if _CLASS[b] == 0]
_CLASS[[b for b in _others if b >= 33]] = 32 + np.arange(sum(b >= 33 for b in _others)) % 31
_CLASS[[b for b in _others if b < 33]] = 30
_CLASS[10] = 31
_CLASS[128:] = 64 + np.arange(128) % 64
#: Pairs of ASCII classes have terms of their own, others share as many by a hash.
ASCII = 64 * 64
PAIRS = 2 * ASCII
_TERM = np.arange(128 * 128, dtype=np.int64)
_TERM = np.where((_TERM // 128 < 64) & (_TERM % 128 < 64), _TERM // 128 * 64 + _TERM % 128, ASCII + (_TERM * 2654435761 >> 16) % ASCII)
#: Beside the pairs: words like the one before, words like the one eight before, word pairs seen before; and all words.
SHARES = 3
TERMS = PAIRS + SHARES + 1
#: Length, next to the unit vector of pairs, of a text in which every word repeats.
REPEATS = 1.5


def counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, TERMS) counts of terms."""
    n = len(off) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(raw):
        return out
    c = _CLASS[raw]
    text = np.repeat(np.arange(n), np.diff(off))
    inside = text[1:] == text[:-1]
    code = (text[1:] * PAIRS + _TERM[c[:-1] * 128 + c[1:]])[inside]
    out[:, :PAIRS] = np.bincount(code, minlength=n * PAIRS).reshape(n, PAIRS)
    start, end, first = word_spans(raw, off)
    h = word_hashes(raw, start, end)
    if len(h) > 1:
        of = np.repeat(np.arange(n), np.diff(first))
        together = of[1:] == of[:-1]
        out[:, PAIRS] = np.bincount(of[1:][together & (h[1:] == h[:-1])], minlength=n)
        out[:, PAIRS + 1] = np.bincount(of[8:][(of[8:] == of[:-8]) & (h[8:] == h[:-8])], minlength=n)
        with np.errstate(over="ignore"):
            two = mix64(h[:-1] * np.uint64(31) + h[1:] + of[1:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[together]
        _, once = np.unique(two, return_index=True)
        again = np.ones(len(two), bool)
        again[once] = False
        out[:, PAIRS + 2] = np.bincount(of[1:][together][again], minlength=n)
    out[:, PAIRS + SHARES] = np.diff(first)
    return out


def _weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of weighted pairs, and beside them the shares of repeated words."""
    out = np.log1p(x[:, : PAIRS + SHARES])
    pairs = out[:, :PAIRS]
    pairs *= idf[:PAIRS]
    norm = np.linalg.norm(pairs, axis=1, keepdims=True)
    pairs /= np.where(norm > 0, norm, 1)
    out[:, PAIRS:] = np.float32(REPEATS) * x[:, PAIRS : PAIRS + SHARES] / np.maximum(x[:, PAIRS + SHARES :], 1)
    return out


class Voter:
    """Broadcast model: idf, projection, unit vectors and labels of the sample."""

    def __init__(self, idf, basis, vectors, labels):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def votes(self, near: np.ndarray) -> np.ndarray:
        """Share of label 1 among the K largest of each row of cosines, weighted by similarity."""
        k = min(K, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(near, at, 1)
        w = np.maximum(top, 1e-6).astype(np.float64) ** POWER
        yes = (w * self.labels[at]).sum(1)
        last = top.min(1)
        tied = (near == last[:, None]).sum(1) > (top == last[:, None]).sum(1)
        for r in np.flatnonzero(tied):  # all that tie at the last place share its votes
            above, equal = top[r] > last[r], near[r] == last[r]
            yes[r] = (w[r] * self.labels[at[r]])[above].sum() + max(last[r], 1e-6) ** POWER * (k - above.sum()) * self.labels[equal].mean()
        return np.clip(yes / w.sum(1), 0, 1)

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.full(len(off) - 1, self.prior)
        if not len(self.labels):
            return out
        for i, j in _groups(off, CHUNK):
            for a in range(i, j, ROWS):
                z = min(j, a + ROWS)
                x = _weigh(counts(raw[off[a] : off[z]], off[a : z + 1] - off[a]), self.idf) @ self.basis
                norm = np.linalg.norm(x, axis=1)
                some = norm > 1e-6
                if some.any():
                    out[a:z][some] = self.votes((x[some] / norm[some, None]) @ self.vectors.T)
        return np.round(out, 6)


def _svd_basis(x: np.ndarray, dims: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration."""
    dims = min(dims, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(dims + 16, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :dims], np.float32)


def _column(batch, at):
    col = batch.column(at).cast(pa.string())
    return text_bytes(col.fill_null("") if col.null_count else col)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dims: int = DIMS) -> Voter:
    """Count terms over all documents, fit the space on a bounded sample of labelled ones."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def frequency(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for b in batches:
            raw, off = _column(b, "text")
            n += len(off) - 1
            for i, j in _groups(off, CHUNK):
                for a in range(i, j, ROWS):
                    z = min(j, a + ROWS)
                    total += (counts(raw[off[a] : off[z]], off[a : z + 1] - off[a]) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(TERMS), -1)), pa.array(np.append(total, n))], ["term", "n"])

    sums = dict(text.select("text").mapInArrow(lean(frequency), "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # TERMS rows
    df = np.array([sums.get(i, 0) for i in range(TERMS)], np.float64)
    idf = np.log((1 + sums.get(-1, 0)) / (1 + df)).astype(np.float32) + np.float32(1)

    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # the first `sample` labelled ids, by their hash, that have a document
    order, size, labelled = [F.xxhash64("doc_id"), F.col("doc_id")], 2 * sample, known.count()
    while True:
        some = known.orderBy(*order).limit(size)
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(some) if size <= LOOKUP else some, "doc_id").distinct().orderBy(*order).limit(sample)
        ids = [r[0] for r in found.collect()]  # at most `sample`
        if len(ids) == sample or size >= labelled:
            break
        size *= 4
    schema = "doc_id long, quality int"
    chosen = docs.sparkSession.createDataFrame(known.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id").select("doc_id", "quality").collect() or [], schema)
    rows = text.join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    # of an id's texts the one with the smallest digest
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.md5("text").alias("m"), "text")).alias("x")).select("doc_id", "quality", "x.text")

    def vectors(batches):
        for b in batches:
            raw, off = _column(b, "text")
            q = b.column("quality").to_pylist()
            ids = b.column("doc_id").to_pylist()
            for i in range(0, len(q), ROWS):
                j = min(len(q), i + ROWS)
                x = _weigh(counts(raw[off[i] : off[j]], off[i : j + 1] - off[i]), idf).astype(np.float16)
                at = [np.flatnonzero(r).astype("<i2") for r in x]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(q[i:j], pa.int32()), pa.array([a.tobytes() for a in at]), pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)])], ["doc_id", "quality", "at", "x"])

    got = rows.mapInArrow(lean(vectors), "doc_id long, quality int, at binary, x binary").collect()
    got.sort(key=lambda r: r[0])
    x, y = np.zeros((len(got), PAIRS + SHARES), np.float32), np.array([r[1] for r in got], np.float64)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r[2], "<i2")] = np.frombuffer(r[3], np.float16)
    if not len(x):
        return Voter(idf, np.zeros((PAIRS + SHARES, 1), np.float32), np.zeros((0, 1), np.float32), y)
    basis = _svd_basis(x, dims)
    v = x @ basis
    norm = np.linalg.norm(v, axis=1)
    some = norm > 1e-6
    return Voter(idf, basis, np.ascontiguousarray(v[some] / norm[some, None]), y[some])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    voter = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        for b in batches:
            raw, off = _column(b, "text")
            s = voter.value.score(raw, off)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= keep).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs."""
    voter = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            raw, off = _column(b, at)
            yield b.filter(pa.array(voter.value.score(raw, off) >= keep))

    return docs.mapInArrow(lean(run), docs.schema)
