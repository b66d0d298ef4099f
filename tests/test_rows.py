"""Graphs as rows: the same as tables, and nothing of a graph is shuffled."""

import pytest
from pyspark.sql import functions as F

from pairwright.operators import graphs as G
from pairwright.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["composed_graph", "flow_node_features", "relation_mapping", "isolated_node_removal", "projected_dependences"])
def test_graphs_are_not_shuffled(spark, name):
    assert "Exchange" not in plan(registry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["laplacian_moments", "combinatorial_moments", "directed_spectra"])
def test_spectra_deal_out_numbers_alone(spark, name):
    p = plan(registry.queries()[name](spark, SF))
    assert p.count("Exchange") == 1 and "Join" not in p and "Sort" not in p


def test_windows_take_graphs_as_they_are_read(spark):
    p = plan(registry.queries()["flow_universe"](spark, SF))
    assert "Join" not in p and "Window" not in p


def test_word_graphs(spark):
    rows = [("a", "t", ["y", "x", "x", "y", "z"]), ("b", "t", []), ("c", "t", None), ("d", "t", ["q"]), ("e", "t", ["é", "z", "é"])]
    w = spark.createDataFrame(rows, "code_id string, layer string, w array<string>").coalesce(1)
    got = {r.code_id: (r.ids, list(zip(r.src, r.dst, strict=True))) for r in G.word_graphs(w, {"": 1}, both=True).collect()}
    assert got == {"a": (["x", "y", "z"], [(0, 1), (1, 0), (1, 2), (2, 1)]), "b": ([], []), "c": ([], []), "d": (["q"], []), "e": (["z", "é"], [(0, 1), (1, 0)])}
    got = {r.code_id: (list(zip(r.c_src, r.c_dst, strict=True)), list(zip(r.d_src, r.d_dst, strict=True))) for r in G.word_graphs(w, {"c_": 1, "d_": 3}).collect()}
    assert got["a"] == ([(0, 0), (0, 1), (1, 0), (1, 2)], [(0, 2), (1, 1)]) and got["d"] == ([], [])


def test_pieces_keep_all_rows(spark):
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([[1] * 5, None, [], [1] * 3, [1] * 9, [1]])], ["w"])
    assert [p.column("w").to_pylist() for p in G.pieces(b, "w", 4)] == [[[1] * 5], [None, [], [1] * 3], [[1] * 9], [[1]]]


def test_overlay_and_degrees(spark):
    g = spark.createDataFrame([(["a", "b", "c"], [0, 1, 1], [1, 0, 2])], "ids array<string>, src array<int>, dst array<int>")
    e = G.row_edges()
    r = g.select(G.overlay(e, G.turned(e)).alias("o"), G.inside(F.transform("ids", lambda x: x < "c")).alias("i"), G.degrees("src", F.size("ids")).alias("d"), G.attached(F.col("ids")).alias("a")).first()
    assert sorted(map(tuple, r.o)) == [(0, 1), (1, 0), (1, 2), (2, 1)] and list(map(tuple, r.i)) == [(0, 1), (1, 0)] and r.d == [1, 2, 0] and r.a == ["a", "b", "c"]


def test_records_are_not_dealt_by_language(spark):
    for name in ("canonical_graphs", "canonical_audit", "lexical_coverage"):
        df = registry.queries()[name](spark, SF)
        assert "SortMergeJoin" not in plan(df) and "BroadcastHashJoin" in plan(df)


def test_projection_of_long_records_is_linear(spark):
    """A record of 30,000 nodes: positions computed again for each edge took minutes."""
    import time

    from pairwright.operators import records as C

    n = 30_000
    ids = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("n"), i.cast("string")))
    edges = F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.struct(i.alias("src"), (i + 1).alias("dst")))
    r = spark.range(1).select(F.lit(n).alias("n")).select(F.lit("x").alias("language"), ids.alias("ids"), ids.alias("ddg_ids"), edges.alias("edges"))
    begin = time.time()
    assert C.with_places(r, 256).select(F.size(C.projected(F.col("edges"), F.col("places"))).alias("k")).first().k == 255
    assert time.time() - begin < 20


def test_parsed_graphs_come_in_batches(spark, monkeypatch):
    monkeypatch.setattr(G, "BATCH", 3)
    rows = [("a", "x = 1\ny = x\n"), ("b", "def (:"), ("c", None), ("d", "z = 2")]
    df = spark.createDataFrame(rows, "code_id string, code string").coalesce(1)
    got = {(r.code_id, r.layer): r for r in G.parse_python(df, keep=True).collect()}
    assert len(got) == 12 and got["b", "ast"].status == "parse_error" and got["c", "ddg"].code is None and got["a", "cfg"].code == rows[0][1]
    for i, code in (("a", rows[0][1]), ("d", rows[3][1])):
        for layer, f in G.LAYERS.items():
            n, e = f(G.parse_source(code)[1])
            assert [tuple(x) for x in got[i, layer].nodes] == n and [tuple(x) for x in got[i, layer].edges] == e


def test_alignment_joins_nothing(spark):
    assert "Join" not in plan(registry.queries()["aligned_dependences"](spark, SF))


def test_plateau_of_a_long_history(spark):
    """Forty thousand epochs of one run: a frame to the end, read again for each row, took minutes."""
    import time

    from pairwright.operators import relational as R

    h = spark.range(60_000).select(F.lit("r").alias("k"), (F.col("id") + 1).cast("int").alias("epoch"), F.when(F.col("id") < 50_000, 60_000.0 - F.col("id")).otherwise(10_000.0).alias("loss"))
    begin = time.time()
    assert [tuple(r) for r in R.plateau(h, ["k"], 0.1).collect()] == [("r", 45_001)]
    assert time.time() - begin < 30
    h = spark.createDataFrame([(None, 1, 5.0), (None, 2, 1.0), ("b", 1, 3.0), ("b", 2, 4.0), ("b", 3, 1.0)], "k string, epoch int, loss double")
    assert {(r.k, r.plateau) for r in R.plateau(h, ["k"], 0.0).collect()} == {(None, 2), ("b", 3)}
