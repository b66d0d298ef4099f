"""Readers, writers and the incremental store on small files."""

import gzip
import io
import json
import os
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwright.operators import relational as R
from pairwright.operators import sampling as S
from pairwright.operators.ordered import running
from pairwright.sources import archives, readers, writers
from pairwright.sources.storage import numbered
from pairwright.streaming import incremental


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = text.encode()
    with open(path, "wb") as f:
        f.write(gzip.compress(data) if path.endswith(".gz") else data)
    return str(path)


def test_find_file(spark, tmp_path):
    for p in ("a/b/x.txt", "z/x.txt", "a/y.txt"):
        put(str(tmp_path / p), "1")
    assert readers.find_file(spark, str(tmp_path), "x.txt").endswith("z/x.txt")
    assert readers.find_file(spark, str(tmp_path), "q", "y.txt").endswith("a/y.txt")
    with pytest.raises(FileNotFoundError):
        readers.find_file(spark, str(tmp_path), "q")


def test_lines_of_any_compression(spark, tmp_path):
    put(str(tmp_path / "a.gz"), "x\n\ny\n")
    with open(tmp_path / "b.gz.tmp", "wb") as f:
        f.write(gzip.compress(b"z\n"))
    put(str(tmp_path / "c"), "w")
    assert sorted(r.value for r in archives.read_lines(spark, str(tmp_path)).collect()) == ["w", "x", "y", "z"]


def test_lines_in_ranges(spark, tmp_path):
    """Every line is in one range, whatever the split; members of one gzip stream follow each other; a broken one is an error."""
    text = "".join(f"{'é' * (i % 5)}{i}\n" + "\n" * (i % 3) for i in range(300)) + "last"
    put(str(tmp_path / "plain.gz.tmp"), text)
    want = sorted(x for x in text.split("\n") if x)
    for split in (1, 7, 64, 10**6):
        assert sorted(r.value for r in archives.read_lines(spark, str(tmp_path), split).collect()) == want
    with open(tmp_path / "two", "wb") as f:
        f.write(gzip.compress(b"a\nb") + gzip.compress(b"c\n\xff\n") + b"\0\0")
    assert sorted(r.value for r in archives.read_lines(spark, str(tmp_path / "two")).collect()) == ["a", "bc", "\ufffd"]
    with open(tmp_path / "cut", "wb") as f:
        f.write(gzip.compress(b"abc" * 1000)[:-12])
    with pytest.raises(Exception, match="ends early"):
        archives.read_lines(spark, str(tmp_path / "cut")).collect()


def test_zip_is_read_in_parts(spark, tmp_path):
    """One file, many tasks: by member, and within stored members by row groups; deflated members too."""
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "x" * (i % 11), [i, i + 1]) for i in range(1000)], "id long, s string, pad array<long>").coalesce(1)
    w = archives.write_parquet_zips(df, str(tmp_path / "z"), "rows", 300)
    (f,) = w.collect()
    assert (f.members, f.rows) == (4, 1000)
    for split, parts in ((1, 14), (10**9, 4)):
        got = archives.read_parquet_zip(spark, f.file, "^rows__", ["s", "id"], split)
        assert got.rdd.getNumPartitions() == parts and got.columns == ["s", "id"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((r.s, r.id) for r in df.collect()), key=str)
    with zipfile.ZipFile(f.file) as a, zipfile.ZipFile(tmp_path / "packed.zip", "w", zipfile.ZIP_DEFLATED) as b:
        b.writestr("folder/", "")
        for n in a.namelist():
            b.writestr(f"folder/{n}", a.read(n))
    assert archives.read_parquet_zip(spark, str(tmp_path / "packed.zip"), "rows__").agg(F.sum("id")).first()[0] == 499500
    assert archives.write_parquet_zips(df.where("false"), str(tmp_path / "none"), "rows", 10).count() == 0


def test_latent_bundle_below_a_folder(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(25)], "code_id long, eigenvalues array<double>").repartition(2)
    w = archives.write_latent_zips(df, str(tmp_path / "z"), 4).collect()
    assert sum(r.rows for r in w) == 25 and sum(r.members for r in w) >= 7
    with zipfile.ZipFile(w[0].file) as a, zipfile.ZipFile(tmp_path / "z" / "deep.zip", "w") as b:
        for n in a.namelist():
            b.writestr(f"out/{n}", a.read(n))
        b.writestr("out/deeper/manifest.json", "{}")
    got = archives.read_latent_zip(spark, str(tmp_path / "z")).collect()
    assert len(got) == 25 + w[0].rows and all(r.eigenvalues == [float(r.code_id), 0.5] for r in got)


@pytest.mark.parametrize("compress", [True, False])
def test_dump(spark, tmp_path, compress):
    rows = [(i, None if i % 5 == 0 else f"a\tb\nc\\d\re{'é' * i}", "" if i % 2 else "x") for i in range(100)] + [(None, None, None), (1, "twice", "y"), (1, "twice", "y")]
    df = spark.createDataFrame(rows, "id long, text string, note string").repartition(2)
    path = str(tmp_path / "d")
    w = archives.write_dumps(df, path, "snippet", "clones", compress, 7).collect()
    assert sum(r.rows for r in w) == len(rows)
    got = archives.read_dump(spark, path, "snippet", ["note", "id", "text", "absent"], "clones")
    assert got.rdd.getNumPartitions() == sum(r.members for r in w)
    assert sorted(((None if r.id is None else int(r.id), r.text, r.note) for r in got.collect()), key=str) == sorted(rows, key=str)
    assert archives.read_dump(spark, path, "snippet", ["id"], "public").count() == archives.read_dump(spark, path, "other", ["id"], "clones").count() == 0
    put(str(tmp_path / "bad"), "no dump")
    with pytest.raises(Exception, match="not a database dump"):
        archives.read_dump(spark, str(tmp_path / "bad"), "x", ["id"]).count()


def test_parquet_in_zip(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for name in ("programs__java", "pairs__x"):
                raw = io.BytesIO()
                pd.DataFrame({"id": [k, 10 + k], "text": ["a", "b"], "n": [1.5, 2.5]}).to_parquet(raw)
                z.writestr(f"{name}.parquet", raw.getvalue())
    df = archives.read_parquet_zip(spark, str(tmp_path / "*.zip"), r"^programs__", ["id", "text"])
    assert df.dtypes == [("id", "bigint"), ("text", "string")]
    assert sorted(map(tuple, df.collect())) == [(0, "a"), (1, "a"), (10, "b"), (11, "b")]
    with pytest.raises(FileNotFoundError):
        archives.read_parquet_zip(spark, str(tmp_path / "*.zip"), "nothing")


def test_copy_sections(spark):
    dump = ["COPY other (a) FROM stdin;", "9\t9", "\\.", "COPY t (a, b) FROM stdin;", "1\tx\\ny", "2\t\\N", "\\.", "3\tout", "COPY t (a, b) FROM stdin;", "4\ta\\\\tb", "\\."]
    lines = spark.createDataFrame([(f, i, v) for f in ("p", "q") for i, v in enumerate(dump)], "file string, number long, value string").repartition(4)
    got = sorted(map(tuple, readers.read_copy_section(lines, "t", ["a", "b"]).collect()))
    assert got == sorted([("1", "x\ny"), ("2", ""), ("4", "a\\tb")] * 2)


def test_clone_dataset(spark, tmp_path):
    root = str(tmp_path / "d")
    put(f"{root}/data.jsonl", "".join(json.dumps({"idx": i, "func": f"f{i}"}) + "\n" for i in range(4)))
    put(f"{root}/train.txt", "0\t1\t1\n3\t2\t0\n")
    put(f"{root}/test.txt", "1\t2\t1\n")
    tsv, jsonl = put(f"{root}/types.tsv", "1\t0\tT1\n1\t2\ttype-3\n"), put(f"{root}/types.jsonl", '{"left": 2, "right": 1, "type": "4"}\n')
    d = readers.read_clone_dataset(spark, root, tsv)
    assert d["codes"].count() == 4
    assert sorted(map(tuple, d["pairs"].select("split", "left_id", "right_id", "label", "clone_type").collect()), key=str) == [("test", "1", "2", 1, "type_3"), ("train", "0", "1", 1, "type_1"), ("train", "3", "2", 0, None)]
    assert {r.clone_type for r in readers.read_clone_dataset(spark, root, jsonl)["pairs"].collect()} == {None, "type_4"}
    with pytest.raises(Exception, match="unknown clone type"):
        readers.read_clone_dataset(spark, root, put(f"{root}/bad.tsv", "0\t1\tT9\n"))["pairs"].collect()
    os.remove(f"{root}/train.txt")
    with pytest.raises(FileNotFoundError):
        readers.read_clone_dataset(spark, root)


def test_clean_bundle(spark, tmp_path):
    root = str(tmp_path / "b")
    put(f"{root}/codes.jsonl.gz", '{"code_id": 1, "code": "x", "lang": "py3", "problem_id": "p"}\n{"id": "2", "source": "y", "language": "Java"}\n')
    put(f"{root}/pairs.csv.gz", "split,left_id,right_id,label\nTrain,1,2,1\nvalid,2,1,0\n")
    put(f"{root}/graph_spectra.jsonl.gz", '{"code_id": "1", "graphs": {"ast": {"eigenvalues": [0.0]}}}\n{"code_id": "3", "graphs": {}}\n')
    b = readers.CleanBundle(spark, root)
    assert {(r.code_id, r.code, r.language) for r in b.codes.collect()} == {("1", "x", "python"), ("2", "y", "java")}
    p = b.pairs("TRAIN").collect()
    assert [(r.left_language, r.right_language, r.left_problem_id, r.label) for r in p] == [("python", "java", "p", 1)]
    assert b.pairs("train", left="java").count() == 0 and b.pairs("valid", left="java", right="python").count() == 1
    assert [r.code_id for r in b.graphs(b.codes).collect()] == ["1"]
    put(f"{root}/pairs.csv.gz", "split,left_id,right_id,label\ntrain,1,9,1\n")
    with pytest.raises(Exception, match="no such code"):
        b.pairs("train").collect()
    put(f"{root}/codes.jsonl.gz", '{"code_id": 1, "code": "x"}\n')
    with pytest.raises(Exception, match="no language"):
        readers.CleanBundle(spark, root).codes.collect()
    assert readers.CleanBundle(spark, root, "c").codes.first().language == "c"


def test_feature_shards_and_stores(spark, tmp_path):
    root = str(tmp_path / "s")
    a, b = (spark.createDataFrame([(str(i), v) for i in ids], "code_id string, v int") for ids, v in (((1, 2), 1), ((2, 3), 2)))
    a.coalesce(1).write.parquet(f"{root}/one")
    b.coalesce(1).write.parquet(f"{root}/two")
    put(f"{root}/manifest.json", json.dumps({"format": "spectral_feature_shards_v1", "shards": ["one"]}))
    need = spark.createDataFrame([("2",)], "code_id string")
    assert [tuple(r) for r in readers.read_feature_shards(spark, root, need).collect()] == [("2", 1)]
    with pytest.raises(ValueError, match="missing"):
        readers.read_feature_shards(spark, root, spark.createDataFrame([("9",)], "code_id string"))
    assert sorted(map(tuple, readers.first_store([a, b]).select("code_id", "v").collect())) == [("1", 1), ("2", 1), ("3", 2)]
    t = spark.createDataFrame([("a", "c", "h"), ("b", "c", ""), ("d", "java", "k"), ("e", "java", "m")], "source_id string, language string, source_sha256 string")
    i = spark.createDataFrame([("a", "h"), ("b", "x"), ("d", "other")], "source_id string, source_sha256 string")
    assert sorted(map(tuple, readers.cache_audit(t, i).collect())) == [("c", 2, 2, 0), ("java", 2, 0, 2)]


def test_latent_bundle_and_results(spark, tmp_path):
    def bundle(path, ids, count):
        raw = io.BytesIO()
        np.savez(raw, code_ids=np.array(ids), eigenvalues=np.arange(len(ids) * 2, dtype=float).reshape(-1, 2))
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("manifest.json", json.dumps({"code_count": count}))
            z.writestr("a.npz", raw.getvalue())
        return str(path)

    assert sorted(map(tuple, archives.read_latent_zip(spark, bundle(tmp_path / "a.zip", ["x", "y"], 2)).collect())) == [("x", [0.0, 1.0]), ("y", [2.0, 3.0])]
    for ids, n in ((["x", "x"], 2), (["x"], 2)):
        with pytest.raises(Exception, match="twice|manifest"):
            archives.read_latent_zip(spark, bundle(tmp_path / "b.zip", ids, n)).collect()
    put(str(tmp_path / "r/k/one.json"), '[{"F1": 0.5, "m": "a"}, {"F1": null, "m": "b"}]')
    assert sorted((r.m, r.source_file) for r in readers.read_results(spark, str(tmp_path / "r"), "F1 double, m string").collect()) == [("a", "one.json"), ("b", "one.json")]


def test_graph_spectra_writer(spark, tmp_path):
    g = spark.createDataFrame([("a", "ast", "n"), ("b", "ast", "m")], "code_id string, layer string, nodes string")
    s = spark.createDataFrame([("a", "ast", 2, "failed", [9.0]), ("a", "ast", 1, "ok", [0.1234567891]), ("b", "ast", 3, "ok", [1.0])], "code_id string, layer string, position int, status string, eigenvalues array<double>")
    path = str(tmp_path / "g")
    writers.write_graph_spectra(g, s, path, precision=4, pairs=spark.createDataFrame([("a", "b")], "left_id string, right_id string"))
    assert sorted((r.code_id, r.spectral_status, r.eigenvalues) for r in spark.read.parquet(path).collect()) == [("a", "ok", [0.1235]), ("b", "ok", [1.0])]
    with pytest.raises(ValueError, match="no graph for z"):
        writers.write_graph_spectra(g, s, path, pairs=spark.createDataFrame([("a", "z")], "left_id string, right_id string"))


def test_writers(spark, tmp_path):
    df = spark.range(25).withColumn("v", F.col("id") * 2)
    m = writers.write_shards(df.coalesce(1), str(tmp_path / "sh"), 10)
    assert sorted(r.rows for r in m.collect()) == [5, 10, 10]
    scores = spark.createDataFrame([("ast", None, "pss", "a", 0.5), ("ast", 8, "pss", "a", 0.25)], "graph_type string, k int, metric string, pair string, score double")
    for _ in range(2):
        writers.append_scores(scores, str(tmp_path / "sc"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sc"))
    assert back.count() == 4 and {r.k for r in back.select(F.col("k").cast("string")).collect()} == {"full", "8"}
    pairs = spark.createDataFrame([("train", "a", "b", 1)], "split string, left_id string, right_id string, label int")
    writers.write_endpoints(pairs, str(tmp_path / "e"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "e")).select("side", "code_id", "label").collect())) == [("left", "a", 1), ("right", "b", 1)]
    path = str(tmp_path / "t")
    writers.replace_table(spark.range(3), path)
    writers.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [x for x in os.listdir(tmp_path) if x.startswith("t.")] == []
    for n in ("a", "b"):
        put(str(tmp_path / "z" / n), "1")
    assert zipfile.ZipFile(writers.zip_bundle(str(tmp_path / "z"), str(tmp_path / "z.zip"), ("a", "b"))).namelist() == ["a", "b"]
    with pytest.raises(FileNotFoundError, match="c"):
        writers.zip_bundle(str(tmp_path / "z"), str(tmp_path / "z.zip"), ("a", "c"))
    rows = spark.createDataFrame([("M1", "D1", 0.5, None), ("M2", "D2", 0.25, 0.75)], "m string, d string, P double, R double")
    assert writers.latex_table(rows, "m", "d", ["P", "R"], ["M2", "M0", "M1"], ["D1", "D2"]).splitlines()[1:] == [r"M2 & -- & -- & 0.2500 & 0.7500 \\", r"M1 & 0.5000 & -- & -- & -- \\"]


def test_incremental_store(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "code_id string, digest string, n int"
    seen = []

    def compute(todo):
        seen.append(sorted(r.code_id for r in todo.collect()))
        return todo.select("code_id", "digest", F.lit("ok").alias("status"), F.array(F.col("n").cast("double")).alias("eigenvalues"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.start(spark, source, schema, store, compute, str(tmp_path / "cp")).awaitTermination()
        return {r.code_id: r.eigenvalues[0] for r in incremental.read_store(spark, store).collect()}

    assert incremental.read_store(spark, store) is None
    assert run([("a", "1", 1), ("b", "1", 2), ("b", "1", 2)]) == {"a": 1.0, "b": 2.0}
    assert run([("a", "1", 9), ("b", "2", 5), ("c", "1", 3)]) == {"a": 1.0, "b": 5.0, "c": 3.0}
    assert seen == [["a", "b"], ["b", "c"]]
    # the same batch again writes the same rows
    incremental.upsert(spark.createDataFrame([("a", "1", 9), ("b", "2", 5), ("c", "1", 3)], schema), 1, store, compute)
    assert spark.read.parquet(store).count() == 4 and {r.code_id: r.eigenvalues[0] for r in incremental.read_store(spark, store).collect()} == {"a": 1.0, "b": 5.0, "c": 3.0}


def test_order_without_one_task(spark):
    df = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id").repartition(7)
    want = sorted((r.v, r.id) for r in df.collect())
    got = {(r.v, r.id): r.k for r in numbered(df, [F.col("v"), F.col("id")], "k").collect()}
    assert [got[x] for x in want] == list(range(1, 501))
    sums = {r.id: r.s for r in running(df, [], [F.desc("v"), F.col("id")], {"s": "v"}).collect()}
    total = 0
    for v, i in sorted(want, key=lambda x: (-x[0], x[1])):
        total += v
        assert sums[i] == total
    assert numbered(df.limit(0), [F.col("v")], "k").count() == 0


def test_selections_against_a_pass_in_order(spark):
    import hashlib
    import random

    r = random.Random(3)
    for trial in range(4):
        pairs = sorted({(r.randrange(25), 30 + r.randrange(25)) for _ in range(110)} | {(k, k) for k in r.sample(range(25), 10)})  # some with one end twice
        df = spark.createDataFrame(pairs, "left_id long, right_id long").repartition(3)
        order = sorted(pairs, key=lambda p: (hashlib.sha256(f"{trial}:{p[0]}/{p[1]}".encode()).hexdigest(), p))
        seen, new, old = set(), [], []
        for p in order:
            (old if set(p) <= seen else new).append(p)
            seen |= set(p)
        got = {tuple(x) for x in S.greedy_cover(df, 40, trial).collect()}
        assert got == set((new + old)[:40])
        for budget in (1, 9, 20, 200):
            seen, kept, rest = set(), [], []
            for p in order:
                if len(kept) < 30 and len(seen | set(p)) <= budget:
                    seen |= set(p)
                    kept.append(p)
                else:
                    rest.append(p)
            kept += [p for p in rest if set(p) <= seen][: 30 - len(kept)]
            assert {tuple(x) for x in S.budget_select(df, 30, budget, trial).collect()} == set(kept), (trial, budget)


def test_code_disjoint_split(spark):
    df = spark.range(2000).select((F.xxhash64("id") % 40).alias("left_id"), (100 + F.xxhash64("id", F.lit(1)) % 40).alias("right_id"), (F.col("id") % 2).cast("int").alias("label")).dropDuplicates(["left_id", "right_id"])
    got = S.code_disjoint_split(df, 1, 3).collect()
    codes = {s: {x for r in got if r.split == s for x in (r.left_id, r.right_id)} for s in ("train", "valid", "test")}
    assert not codes["train"] & codes["valid"] and not codes["train"] & codes["test"] and not codes["valid"] & codes["test"]
    n = {(r.split, r.label): 0 for r in got}
    for r in got:
        n[r.split, r.label] += 1
    assert n["train", 0] == n["train", 1] > n["valid", 0] == n["valid", 1] > 0 and n["test", 0] == n["test", 1]
    assert sorted(got) == sorted(S.code_disjoint_split(df.repartition(5), 1, 3).collect())


def test_guards(spark):
    runs = spark.createDataFrame([("a", "h1", "p"), ("a", "h2", "p"), ("b", "h1", None), ("b", "h1", None)], "arm string, code string, plan string")
    assert {r.arm: r.poolable for r in R.single_valued(runs, ["arm"], ["code", "plan"]).collect()} == {"a": False, "b": True}
    with pytest.raises(ValueError, match="a"):
        R.require_single_valued(runs, ["arm"], ["code"])
    snaps = spark.createDataFrame([("x", False, [1, 2, 3], 9, "p"), ("x", True, [1, 2], 1, "q"), ("y", False, [], 0, "r")], "identity string, complete boolean, history array<int>, steps int, source string")
    assert sorted((r.identity, r.source) for r in R.best_snapshot(snaps).collect()) == [("x", "q"), ("y", "r")]
    bad = spark.createDataFrame([("x", True, [1, 5], 1, "q"), ("x", True, [1, 2, 3], 1, "p")], snaps.schema)
    with pytest.raises(Exception, match="divergent"):
        R.best_snapshot(bad).collect()


def test_effective_rank(spark):
    from pairwright.operators.matrices import gram, spectral_rank

    r = np.random.default_rng(1)
    for shape, scale in (((50, 6), 1.0), ((40, 5), [10, 1, 0, 0, 0])):
        v = r.standard_normal(shape) * scale
        s = np.linalg.svd(v - v.mean(0), compute_uv=False) ** 2
        s = s / s.sum()
        df = spark.createDataFrame([(x.tolist(),) for x in v] + [(None,)], "v array<double>").repartition(4)
        n, d, rank = spectral_rank(df, "v")
        assert (n, d) == shape and abs(rank - np.exp(-(s[s > 0] * np.log(s[s > 0])).sum())) < 1e-6
    one = spark.createDataFrame([([1.0, 1.0],)] * 4, "v array<double>")
    assert spectral_rank(one, "v") == (4, 2, 0.0) and spectral_rank(one.limit(0), "v") == (0, 0, 0.0)
    with pytest.raises(ValueError, match="a matrix of 1"):
        spectral_rank(one, "v", 1)
    with pytest.raises(Exception, match="different lengths"):
        gram(one.union(spark.createDataFrame([([1.0],)], "v array<double>")).coalesce(1), "v").collect()


def test_subset_and_pair_guards(spark, tmp_path):
    from pairwright.operators import splits as P

    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "program_id string, n int")
    writers.write_subset(df, spark.createDataFrame([("c",), ("a",), ("c",)], "program_id string"), str(tmp_path / "sub"))
    assert sorted(r.program_id for r in spark.read.parquet(str(tmp_path / "sub")).collect()) == ["a", "c"]
    pairs = spark.createDataFrame([("train", "a", "b", 1), ("train", "b", "a", 1), ("test", "c", "d", 0)], "split string, left_id string, right_id string, label int")
    assert sorted(map(tuple, P.distinct_pairs(pairs).collect())) == [("test", "c", "d", 0), ("train", "a", "b", 1)]
    with pytest.raises(ValueError, match="a/b"):
        P.distinct_pairs(pairs.unionByName(spark.createDataFrame([("test", "b", "a", 0)], pairs.schema)))
    keys = {"pair": P.unordered(), "end": F.col("left_id")}
    assert P.require_disjoint(pairs, keys).count() == 3
    with pytest.raises(ValueError, match="share 1 by pair"):
        P.require_disjoint(pairs.unionByName(spark.createDataFrame([("test", "b", "a", 0)], pairs.schema)), {"pair": P.unordered()})


def test_generated_pairs(spark):
    from pairwright.operators import splits as P

    codes = spark.createDataFrame([(i, f"p{i % 12}", "en", ("train", "test")[i % 12 % 2], f"code {i if i % 7 else 0}") for i in range(240)], "code_id long, problem_id string, language string, split string, code string")
    got = P.generate_pairs(codes, 15).collect()
    text = {r.code_id: (r.problem_id, r.code) for r in codes.collect()}
    n = {}
    for r in got:
        (pa, ta), (pb, tb) = text[r.left_id], text[r.right_id]
        assert r.left_id < r.right_id and ta != tb and (pa == pb) == (r.label == 1)
        n[r.split, r.label] = n.get((r.split, r.label), 0) + 1
    assert n == {(s, y): 15 for s in ("train", "test") for y in (0, 1)} and len(set(got)) == 60
    assert sorted(got) == sorted(P.generate_pairs(codes.repartition(5), 15).collect())


def test_cheapest_quotas():
    """Row and column sums are kept with the fewest units beyond what a cell wanted: every table of small size is tried."""
    import itertools

    r = np.random.default_rng(6)
    for _ in range(25):
        wanted = r.integers(0, 4, (2, 3))
        capacity = np.maximum(wanted + r.integers(-2, 3, (2, 3)), 0)
        best = None
        for x in itertools.product(*[range(c + 1) for c in capacity.ravel()]):
            t = np.array(x).reshape(2, 3)
            if (t.sum(0) == wanted.sum(0)).all() and (t.sum(1) == wanted.sum(1)).all():
                cost = np.maximum(t - wanted, 0).sum()
                best = cost if best is None else min(best, cost)
        if best is None:
            with pytest.raises(ValueError):
                S.capacity_quotas(wanted, capacity)
            continue
        got = S.capacity_quotas(wanted, capacity)
        assert (got >= 0).all() and (got <= capacity).all() and (got.sum(0) == wanted.sum(0)).all() and (got.sum(1) == wanted.sum(1)).all()
        assert np.maximum(got - wanted, 0).sum() == best
