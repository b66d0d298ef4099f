"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from .test_operators import brute_align, brute_classes

import corpus_pipeline
from pairwright.llm import decontaminate, mixing, quality_knn
from pairwright.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def late(i):
    """Ids in order, none last."""
    return i is None, i or 0


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def words(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return decontaminate.tokens(raw, np.array([0, len(raw)]))[0]


def odd_tables(spark, folder):
    """The small tables with rows that repeat, nulls in every column, one id and text in several sources, and very long texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    good = next(r for r in rows if r[1] and len(r[1].split()) > 60)
    rows += [rows[3], rows[3], rows[7], (None, good[1], "en", "web", 5), (None, good[1], "en", "web", 5), (5001, None, None, None, None), (5002, "", "en", "web", 0), (None, None, None, None, None)]
    rows += [(6000, good[1] + " and more words here", "en", s, 1) for s in ("web", "web", "forum", None, "a new source", "a new source")]
    rows.append((6001, " ".join(f"{w}{i}" for i, w in enumerate(good[1].split() * 200)), "fr", "web", 1))
    docs.sparkSession.createDataFrame(rows, docs.schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df.unionByName(df.limit(3)).unionByName(spark.createDataFrame([(None,) * len(df.columns)], df.schema)).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("odd", [False, True])
def test_stages(spark, tmp_path, odd):
    from tokenizers import Tokenizer

    sf = odd_tables(spark, tmp_path) if odd else SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in df.collect()]
        df = stage(spark, df, sf)
        rows = [tuple(r) for r in df.collect()]
        kept[name] = (before, rows)
        if name != "token output":
            assert df.columns == columns
            df = spark.createDataFrame(rows, docs.schema).repartition(3)
    before, rows = kept["quality classifier"]
    score = quality_knn.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")).score
    raw = [(r[1] or "").encode() for r in before]
    good = [bool(score(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] >= 0.7) for x in raw]
    assert Counter(rows) == Counter(r for r, ok in zip(before, good, strict=True) if ok)

    before, rows = kept["near duplicates"]
    want = [min((before[i][0] for i in g), key=late) for g in brute_classes([(r[0], r[1], None, None) for r in before]).values()]
    assert Counter(r[0] for r in rows) == Counter(want) and not Counter(rows) - Counter(before)

    before, rows = kept["decontamination"]
    items = [w for w in (words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) if len(w) >= 3]
    left = Counter(rows)
    for r in before:
        w = words(r[1])
        shared = [q for q in items if len(set(q.tolist()) & set(w.tolist())) >= len(set(q.tolist())) // 2]
        leak = any(brute_align(w.tolist(), q.tolist()) >= len(q) for q in shared)
        assert (left[r] == 0) == leak and left[r] in (0, Counter(before)[r]), r[0]

    before, rows = kept["mixing"]
    mixed = mixing.mix(spark.createDataFrame(before, docs.schema)).collect()
    want = Counter()
    for r in mixed:
        want[r.doc_id, r.size, r.source_size] += r.copies
    sizes = Counter()
    for r in before:
        sizes[r[3]] += count(r[1])
    assert Counter((r[0], count(r[1]), sizes[r[3]]) for r in rows) == +want and not set(rows) - set(before)

    before, rows = kept["token output"]
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in before:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r[0], r[2], r[3]) for r in rows) == want
