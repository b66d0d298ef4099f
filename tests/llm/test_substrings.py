"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairwright.llm import substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, did string, z int"


def brute(units, size):
    """units: a sequence for each text. Removed positions by text."""
    count = Counter(tuple(u[i : i + size]) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - size + 1):
            if count[tuple(u[i : i + size])] > 1:
                gone[i : i + size] = True
        out.append(gone)
    return out


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 5))) for _ in range(300)]
    passage = [[r.choice(vocab) for _ in range(r.randint(5, 80))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 6)):
            words += r.choice(passage) if r.random() < 0.4 else [r.choice(vocab) for _ in range(r.randint(1, 60))]
            if r.random() < 0.3 and words:
                words[r.randrange(len(words))] = "edited"
        rows.append((i, "".join(w + r.choice([" ", "\n", "  ", "\t"]) for w in words)))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "a " * 500), (104, "x" * 3000), (105, " \n\t"), (3, rows[3][1]), (None, rows[5][1]), (106, "nbsp x y\u0085z " * 30)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(a, b, "x", "y", 1) for a, b in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, substring_dedup.dedup(docs, size=12, gram=4).collect()), key=str)
    units = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    want = []
    for (i, _), u, gone in zip(rows, units, brute(units, 12), strict=True):
        kept = " ".join(w for w, g in zip(u, gone, strict=True) if not g)
        want.append((i, len(u), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(a, b, "x", "y", 1) for a, b in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, suffix_dedup.dedup(docs, size=40, gram=8).collect()), key=str)
    units = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), u, gone in zip(rows, units, brute(units, 40), strict=True):
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want.append((i, len(u), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.dedup(docs).count() == 0
    assert suffix_dedup.dedup(docs).count() == 0


def common_passages(n, passage, vocab, seed):
    """n documents that hold one passage, or most of it, in contexts of their own: its minimizers are frequent."""
    r = random.Random(seed)
    some = lambda k: [r.choice(vocab) for _ in range(k)]
    rows = []
    for i in range(n):
        a = r.randint(0, 3)
        rows.append((i, " ".join(some(r.randint(0, 40)) + passage[a : len(passage) - r.randint(0, 3)] + some(r.randint(0, 40)))))
    rows += [(n, " ".join(some(20) + passage * 30)), (n + 1, "same " * 600), (n + 2, "same " * 601), (0, rows[0][1]), (None, None)]
    return rows


@pytest.mark.parametrize("hot", [1, 3, 256])
@pytest.mark.parametrize("length", [11, 12, 20])
def test_words_of_frequent_minimizers(spark, hot, length):
    r = random.Random(length)
    vocab = [f"v{k}" for k in range(3000)]
    rows = common_passages(60, [f"p{k}" for k in range(length)], vocab, r.random())
    docs = spark.createDataFrame([(a, b, "x", "y", 1) for a, b in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, substring_dedup.dedup(docs, size=12, gram=4, hot=hot).collect()), key=str)
    units = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    want = []
    for (i, _), u, gone in zip(rows, units, brute(units, 12), strict=True):
        kept = " ".join(w for w, g in zip(u, gone, strict=True) if not g)
        want.append((i, len(u), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_production_sizes(spark):
    """35 words and 400 bytes, with frequent minimizers and a very long text."""
    r = random.Random(77)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 12))) for _ in range(4000)]
    rows = common_passages(80, [r.choice(vocab) for _ in range(60)], vocab, 5)
    rows.append((900, " ".join(r.choice(vocab) for _ in range(30_000)) + " " + rows[4][1]))
    docs = spark.createDataFrame([(a, b, "x", "y", 1) for a, b in rows], SCHEMA).repartition(3)
    units = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    want = sorted(((i, len(u), int(g.sum())) for (i, _), u, g in zip(rows, units, brute(units, 35), strict=True)), key=str)
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    bytes_want = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k] += 1
                gone[min(len(b), k + 400)] -= 1
        gone = np.cumsum(gone)[:-1] > 0 if len(b) else gone[:0] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        bytes_want.append((i, len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    for hot in (8, 256):
        got = substring_dedup.dedup(docs, hot=hot).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_removed) for x in got), key=str) == want
        got = suffix_dedup.dedup(docs, hot=hot).collect()
        assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in got), key=str) == sorted(bytes_want, key=str)
