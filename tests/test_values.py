"""Hand-checked values, invariants and errors."""

import hashlib


import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions import spectra as S
from pairwright.functions import text as X
from pairwright.operators import graphs as G
from pairwright.operators import inference as I
from pairwright.operators import metrics as M
from pairwright.operators import relational as R
from pairwright.operators import sampling as P
from pairwright.operators import splits as C
from pairwright.operators import thresholds as T
from pairwright.sources import readers, writers

A, B, D = [0.0, 0.5, 1.0, 1.5], [0.0, 1.0, 2.0], [0.0, 0.6, 1.0, 1.4]
CASES = [
    ("pss", A, B, 1.0), ("pss", [*A, 0.0, 0.0], A, 1.0), ("pss", A, D, 0.4872194678), ("pss", [0.0, 0.0], A, 0.0),
    ("wasserstein", A, B, 0.0356739933), ("wasserstein", A, D, 0.6065306597), ("fisher", A, B, 0.5982325184),
    ("heat_kernel", A, B, 0.6893443290), ("cosine", A, B, 0.5976143047), ("topk_largest", A, B, 0.5857864376),
    ("unknown", A, B, 0.0), ("pss", [], A, 0.0), ("cosine", None, A, 0.0),
]


def test_similarities(spark):
    for metric in {c[0] for c in CASES}:
        rows = [c for c in CASES if c[0] == metric]
        df = spark.createDataFrame([(i, a, b) for i, (_, a, b, _) in enumerate(rows)], "i int, ev1 array<double>, ev2 array<double>")
        got = {r.i: r.score for r in S.pair_scores(df, metric).collect()}
        for i, (_, _, _, want) in enumerate(rows):
            assert abs(got[i] - want) < 1e-9, (metric, i)


def test_jensen_shannon():
    assert abs(S.jensen_shannon(A, A) - 1) < 1e-9
    assert 0 < S.jensen_shannon(A, [5.0, 6.0, 7.0]) < 0.2
    assert abs(S.jensen_shannon([1.0], [1.0]) - 1) < 1e-9 and S.jensen_shannon([], A) == 0


def test_exact_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.4), (1, 0.3)], "label int, score double")
    f1, acc = (T.best(df, [], "exact", m).first() for m in ("f1", "accuracy"))
    assert (f1.threshold, round(f1.best_value, 6)) == (0.3, 0.75)
    assert (acc.threshold, round(acc.best_value, 6)) == (0.9, 0.6)


def test_threshold_against_all(spark):
    y, p = [0, 0, 0, 1, 1], [0.1, 0.8, 0.2, 0.7, 0.6]
    df = spark.createDataFrame(list(zip(y, p, strict=True)), "label int, score double")
    got = T.best(df, [], "pr_curve_all", "accuracy").first()
    best = max(np.mean([(s >= t) == bool(v) for v, s in zip(y, p, strict=True)]) for t in [*p, 2.0])
    assert got.best_value == best
    low = T.best(df.withColumn("score", -F.col("score")), [], "sweep", "accuracy", lower_is_clone=True).first()
    assert low.best_value == best


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double").withColumn("g", F.lit("x"))
    assert M.roc_auc(df, ["g"]).first().auc == 0.75
    assert abs(M.average_precision(df, ["g"]).first().average_precision - (1 + 2 / 3) / 2) < 1e-12
    assert M.roc_auc(df.where("label = 1"), ["g"]).first().auc is None
    values = spark.createDataFrame([(1,), (2,), (2,), (5,)], "v int").withColumn("g", F.lit(1))
    assert abs(M.gini(values, ["g"], "v").first().gini - 0.3) < 1e-12


def test_hash_functions(spark):
    df = spark.createDataFrame([("0",), ("1",), ("7",), ("100",)], "r string")
    got = {r.r: (round(r.f, 6), r.s) for r in df.select("r", P.hash_fraction(F.concat(F.lit("revision-problem-v1/42/"), "r")).alias("f"), C.hash_split(F.col("r"), "revision-problem-v1/42/").alias("s")).collect()}
    assert got == {"0": (0.083568, "train"), "1": (0.299311, "train"), "7": (0.584184, "train"), "100": (0.740612, "valid")}
    one = spark.createDataFrame([("anchor-1",)], "a string").select(P.hash_choice(F.col("a"), F.lit(3)).alias("x"), P.hash_choice(F.col("a"), F.lit(5)).alias("y")).first()
    assert tuple(one) == (2, 0)
    ranked = spark.createDataFrame([(f"p{i}",) for i in range(1, 6)], "p string").orderBy(P.hash_rank(F.col("p"), 20260815)).collect()
    assert [r.p for r in ranked] == ["p3", "p2", "p5", "p1", "p4"]
    assert hashlib.sha256(b"train/c0/c1").hexdigest()[:24] == "e6fc25e282cb96efd6ebfb71"


def test_quotas(spark):
    w = spark.createDataFrame([("train", 70), ("valid", 15), ("test", 15)], "s string, w int")
    assert {r.s: r.quota for r in P.largest_remainder(w, "s", "w", 800).collect()} == {"train": 560, "valid": 120, "test": 120}
    wanted, room = np.array([[56, 12, 12], [56, 12, 12]]), np.array([[40, 40, 40], [90, 90, 90]])
    got = P.capacity_quotas(wanted, room)
    assert (got <= room).all() and (got.sum(1) == wanted.sum(1)).all() and (got.sum(0) == wanted.sum(0)).all()
    with pytest.raises(ValueError):
        P.capacity_quotas(wanted, np.zeros((2, 3), int))
    with pytest.raises(Exception, match="fewer than"):
        P.exact_quota(w, ["s"], "s", 2, 1).collect()


def test_components(spark):
    codes = spark.createDataFrame([("0", "same"), ("1", "same"), ("1", "x"), ("2", "x"), ("9", "y"), ("9", "z")], "problem_id string, code string")
    got = {r.problem_id: r.root for r in C.problem_splits(codes).collect()}
    assert got == {"0": "0", "1": "0", "2": "0", "9": "9"}
    given = spark.createDataFrame([("a", "k", "train"), ("b", "k", "test"), ("c", "l", "train")], "code_id string, code string, split string")
    assert {r.code_id: r.split for r in C.provided_splits(given).collect()} == {"a": "excluded_conflicting_component", "b": "excluded_conflicting_component", "c": "train"}


def test_text(spark):
    df = spark.createDataFrame([("one\n\nthree\n",), ("",), ("a\r\nb",)], "t string")
    assert [r.n for r in df.select(X.line_count(F.col("t")).alias("n")).collect()] == [3, 1, 2]
    c = spark.createDataFrame([("int f(int a){ return a; } // x", "int  f(int a){ return a; }"), ("int f(int a){ return a; }", "int g(int b){ return b; }"), ("x = 1", "while (true) { go(); }")], "a string, b string")
    assert [r.k for r in c.select(X.clone_type(F.col("a"), F.col("b")).alias("k")).collect()] == [1, 2, 4]
    g = spark.createDataFrame([("int getX() { return x; }",), ("void setX(int v) { this.x = v; }",), ("int getX(int a) { return x; }",), ("void setX(int v) { if (v > 0) x = v; }",), ("void run() { }",)], "c string")
    assert [r.k for r in g.select(X.is_accessor(F.col("c")).alias("k")).collect()] == [True, True, False, False, False]
    with pytest.raises(Exception, match="unsupported source language"):
        spark.createDataFrame([("cobol",)], "l string").select(X.language(F.col("l"))).collect()
    assert X.lexical_ids("12") == [0, 0, 0, 0] and X.lexical_ids("getValue")[0] == X.bucket("sub:get", 4096)


def test_graphs(spark):
    path = np.array([0, 1, 2]), np.array([1, 2, 3])
    assert np.allclose(G.spectrum(4, *path, "normalized_laplacian")[1], [0, 0.5, 1.5, 2])
    star = np.array([0, 0, 0]), np.array([1, 2, 3])
    assert np.allclose(G.spectrum(5, *star, "normalized_laplacian")[1], [0, 0, 1, 1, 2])
    assert G.spectrum(0, *path, "laplacian")[0] == "missing_or_empty_graph"
    with pytest.raises(ValueError, match="unknown spectral mode"):
        G.laplacian(4, *path, "other")
    nodes = spark.createDataFrame([("a", "x", n, "T", "") for n in "123"] + [("b", "x", n, "T", "") for n in "12"], "code_id string, layer string, node_id string, type string, label string")
    edges = spark.createDataFrame([("a", "x", "1", "1")], "code_id string, layer string, src string, dst string")
    assert sorted((r.code_id, r.node_id) for r in G.drop_isolated(nodes, edges).collect()) == [("a", "1"), ("b", "1"), ("b", "2")]
    assert G.graph_edit_similarity(2, {(0, 1)}, 2, {(0, 1)}) == 1.0 and G.graph_edit_similarity(9, set(), 9, set()) == 1.0
    v = G.subtree_vectors({0: [1, 2], 1: [3, 4]}, list("abbcc"), {"a": 0, "b": 1, "c": 2})
    assert v.tolist() == [[1, 2, 2, 5], [0, 1, 2, 3]] and abs(G.subtree_similarity(v, v) - 1) < 1e-12


def test_relational(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="not unique"):
        R.one_to_one(a, a, "k")
    assert R.same_rows(a, a.orderBy("v"), ["k", "v"]) and not R.same_rows(a, a.limit(1), ["k", "v"])
    pairs = spark.createDataFrame([("1", "2", 1)], "left_id string, right_id string, label int")
    with pytest.raises(Exception, match="no such code"):
        R.attach(pairs, spark.createDataFrame([("1", "py")], "code_id string, language string"), "language").collect()


def test_files(spark, tmp_path):
    pairs = spark.createDataFrame([("train", "a", "b", 1), ("test", "c", "d", 0)], "split string, left_id string, right_id string, label int")
    meta = pairs.select("split", "left_id", "right_id").withColumn("origin", F.struct(F.lit(1).alias("z")))
    writers.write_pairs(pairs, str(tmp_path / "pairs"), meta)
    back = readers.read_pairs_csv(spark, str(tmp_path / "pairs"))
    assert back.columns == ["split", "left_id", "right_id", "label", "label_name", "origin"] and back.count() == 2
    with pytest.raises(Exception, match="align"):
        writers.write_pairs(pairs, str(tmp_path / "bad"), meta.limit(1))
    (tmp_path / "tsv").mkdir()
    (tmp_path / "tsv" / "train.txt").write_text("a\tb\t1\n\nc\td\t0\n")
    assert readers.read_pairs_tsv(spark, str(tmp_path / "tsv")).count() == 2
    (tmp_path / "tsv" / "valid.txt").write_text("a\tb\n")
    with pytest.raises(Exception, match="three columns"):
        readers.read_pairs_tsv(spark, str(tmp_path / "tsv")).collect()
    dump = ["COPY other (x) FROM stdin;", "9", "\\.", "COPY t (a, b) FROM stdin;", "1\tx\\ny", "\\N\tc\\\\n", "\\.", "7\tz"]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(dump)], "file string, number int, value string")
    assert sorted(tuple(r) for r in readers.read_copy_section(lines, "t", ["a", "b"]).collect()) == [("", "c\\n"), ("1", "x\ny")]
    codes = spark.createDataFrame([("1", "a\nb")], "code_id string, code string")
    writers.write_codes(codes, str(tmp_path / "codes"))
    assert readers.read_jsonl(spark, str(tmp_path / "codes"), "code_id string, line_count int").first().line_count == 2


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0)], "arm string, v double")
    r = I.seed_summary(df, ["arm"], "v").collect()
    assert len(r) == 1 and abs(r[0].high - (2 + 4.302653 / 3**0.5)) < 1e-6
    assert {x.arm: x.variance for x in I.finite_mean_var(df, ["arm"], "v").collect()} == {"a": 1.0, "b": 0.0}



def test_transfer_rows(spark):
    from pairwright.operators import transfer

    rows = transfer.plan(spark.createDataFrame([(x,) for x in "abcd"], "language string")).collect()
    count = {k: sum(r.kind == k for r in rows) for k in ("within", "cross", "bridge1", "bridge2", "bridge3")}
    assert count == {"within": 4, "cross": 6, "bridge1": 12, "bridge2": 48, "bridge3": 96}
    assert len({(r.kind, r.path, r.reinforced) for r in rows}) == 166
    assert all(r.test not in r.train.split(",") for r in rows if r.kind != "within")


def test_graphs_of_whole_texts(spark, tmp_path):
    """Words after the 64th are nodes, tell structures apart and count in sizes."""
    from pairwright.plans import graphs

    head = " ".join(f"h{i % 10}" for i in range(64))
    rows = [(k, head + " " + " ".join(f"t{j}" for j in range(5 * k)), "en", "s", 100 * k) for k in range(1, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.code_id: (r.num_nodes, r.k) for r in graphs.directed_spectra(spark, str(tmp_path)).collect()}
    assert got == {str(k): (10 + 5 * k, 10 + 5 * k) for k in range(1, 5)}
    h = graphs.graph_health(spark, str(tmp_path)).first()
    assert (h.language, h.codes, h.coverage, h.skeleton_rate, h.spearman, h.unique_rate) == ("en", 4, 1.0, 0.0, 1.0, 1.0)


def test_component_sizes_of_all_edges(spark, tmp_path):
    """Edges of every kind count: brute force over the whole table."""
    from pairwright.plans import splits

    rng = np.random.default_rng(4)
    rows = [(k, 1, int(rng.integers(40)), int(rng.integers(40)), 1.0, "ANR"[k % 3]) for k in range(45)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    group = {}
    for _, _, p, s, *_ in rows:
        both = group.get(f"p{p}", {f"p{p}"}) | group.get(f"s{s}", {f"s{s}"})
        group.update(dict.fromkeys(both, both))
    sizes = [len(g) for g in {id(g): g for g in group.values()}.values()]
    got = splits.component_size_statistics(spark, str(tmp_path)).first()
    assert tuple(got) == (len(sizes), max(sizes), len(group), sizes.count(2))


def test_long_fragments_and_every_word(spark, tmp_path):
    """Long documents get a clone type, and every word of a text is sketched."""
    from pairwright.plans import text

    long = "int  f(int a){ return a; } " * 400
    rows = [(1, long), (2, long.replace("  ", " ")), (3, "getValue x1\n12  done"), (4, ""), (5, None)]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.clone_type for r in text.clone_type_infer(spark, str(tmp_path)).collect()} == {1: 1, 2: 4, 3: 4, 4: 4}
    got = {r.doc_id: r.ids for r in text.lexical_sketch(spark, str(tmp_path)).collect()}
    for i, t in rows:
        assert got[i] == (None if t is None else [X.lexical_ids(w) for w in t.split()])
