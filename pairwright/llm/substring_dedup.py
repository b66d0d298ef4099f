"""Substring dedup with repeated-phrase automata.

Recurring passages are confirmed among windows that share a minimizer, compiled into
Aho-Corasick automata (one per shard of minimizers), and the texts of that shard are streamed
through them, which locates every occurrence. A word is removed if a window of `size` words that
starts anywhere else too covers it.

Not every copy of a text is streamed: stretches of windows whose minimizer stands nowhere else
cannot hold a recurring passage and are passed over, and stretches that are equal as a whole (by two
64-bit hashes) are streamed once, with their number, and share what was found. Every other
stretch of every document goes through the automata.

Cases: a null or empty text, or one of fewer than `size` words, loses nothing; a very long text is
searched whole; rows that repeat are each other's copies; extra columns are ignored; an empty table
gives an empty result. Windows never cross texts and are judged on the input.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, lean, mix64, unpack, word_spans
from .segments import HOT, _kgrams, grams, merged, repeated_windows, whole_texts, word_symbols

SIZE = 35
#: Words of the k-grams whose smallest hash deals out the windows.
GRAM = 6
#: Bytes of distinct candidate passages in one shard's automaton.
BATCH = 1 << 20


def passages(ids: np.ndarray, owner: np.ndarray, ends: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and windows of recurring passages: runs of windows that always stand together.

    ids: word numbers of all strings, one after the other; owner: the string of each word;
    ends: where each string ends.
    """
    n = len(ids)
    at = np.flatnonzero(np.arange(n) + size <= ends[owner])
    if not len(at):
        return at, at
    with np.errstate(over="ignore"):
        grams = _kgrams(mix64(ids.astype(np.uint64) + np.uint64(1)), size)[at]
    _, first, uid = np.unique(grams, return_index=True, return_inverse=True)
    count = np.bincount(uid, weights[owner[at]])
    again = count[uid] > 1
    joined = np.append((at[1:] == at[:-1] + 1) & (owner[at[1:]] == owner[at[:-1]]), False)
    follow = np.where(joined, np.append(uid[1:], -1), -1)
    before = np.append(-1, np.where(joined[:-1], uid[:-1], -1))
    same_next = np.ones(len(first), bool)
    same_next[uid[follow != follow[first][uid]]] = False
    same_last = np.ones(len(first), bool)
    same_last[uid[before != before[first][uid]]] = False
    link = joined & again & same_next[uid]
    link[:-1] &= same_last[uid[1:]] & again[1:]
    start = again & ~np.append(False, link[:-1])
    stop = np.flatnonzero(~link)
    heads = np.flatnonzero(start)
    heads = heads[np.unique(uid[heads], return_index=True)[1]]
    runs = stop[np.searchsorted(stop, heads)] - heads + 1
    return at[heads], runs


def _letters(ids: np.ndarray) -> str:
    """Two characters a word, from two alphabets, so that matches begin and end with words."""
    pair = np.empty((len(ids), 2), "<u4")
    pair[:, 0] = 0x10000 + ids // 1024
    pair[:, 1] = 0x1000 + ids % 1024
    return pair.tobytes().decode("utf-32-le")


def repeated(contents: list[bytes], weights: np.ndarray, size: int) -> list[np.ndarray]:
    """For each string the [start, stop) ranges of its windows that occur twice or more."""
    lists = [c.split() for c in contents]
    lens = np.array([len(x) for x in lists], np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for x in lists for w in x), np.int64, int(lens.sum()))
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(lens)), lens)
    heads, runs = passages(ids, owner, ends, weights, size)
    if not len(heads):
        return [np.zeros((0, 2), np.int64)] * len(contents)
    text = _letters(ids)
    automaton = ahocorasick.Automaton()
    for i, (a, r) in enumerate(zip(heads.tolist(), runs.tolist(), strict=True)):
        automaton.add_word(text[2 * a : 2 * (a + r + size - 1)], i)
    automaton.make_automaton()
    found, seen = [], np.zeros(len(heads), np.int64)
    for i, (a, b) in enumerate(zip((ends - lens).tolist(), ends.tolist(), strict=True)):
        for end, k in automaton.iter(text[2 * a : 2 * b]):
            found.append((i, k, (end + 1) // 2))
            seen[k] += weights[i]
    where = np.array(found, np.int64).reshape(-1, 3)
    where = where[seen[where[:, 1]] > 1]
    stop = where[:, 2] - size + 1
    out = np.column_stack([stop - runs[where[:, 1]], stop])
    at = np.searchsorted(where[:, 0], np.arange(len(lens) + 1))
    return [out[at[i] : at[i + 1]] for i in range(len(lens))]


def _cut(raw: bytes, start, width) -> list[bytes]:
    a = np.frombuffer(raw, np.uint8)
    first, last, _ = word_spans(a, np.array([0, len(a)]))
    return [raw[first[s] : last[s + w - 1]] for s, w in zip(start.tolist(), width.tolist(), strict=True)]


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of docs."""
    rows = keyed(docs, id_col, text_col)
    spans = repeated_windows(rows, word_symbols, _cut, size, grams(size, gram), lambda c, w: repeated(c, w, size), "op1", BATCH, hot)

    def finish(batches):
        for b in batches:
            out = []
            for doc, z, marks in zip(b.column("id").to_pylist(), b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = unpack(z).split()
                gone, kept = 0, words
                if marks:
                    start, end = merged(marks, size)
                    gone = int((end - start).sum())
                    kept = [w for a, z in zip([0, *end.tolist()], [*start.tolist(), len(words)], strict=True) for w in words[a:z]]
                text = b" ".join(kept)
                out.append((doc, len(words), gone, hashlib.sha256(text).hexdigest(), *([text.decode()] if keep_text else [])))
            cols = list(zip(*out, strict=True)) or [[]] * (4 + keep_text)
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + keep_text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + keep_text])

    return whole_texts(rows, spans).mapInArrow(lean(finish), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
