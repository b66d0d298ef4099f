"""Work that grows no faster than its input: steps that read, shuffle or hold more than they need."""

import numpy as np
from pyspark.sql import functions as F

from pairwright.functions import spectra as S
from pairwright.functions import text as X
from pairwright.operators import graphs as G
from pairwright.operators import learners as L
from pairwright.operators import records as C
from pairwright.operators import relational as R
from pairwright.operators import sampling as P
from pairwright.operators import splits as T
from pairwright.plans import registry
from pairwright.sources import adapters as A
from pairwright.sources import archives

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_diagnostics_are_one_pass_of_a_spectrum(spark):
    df = spark.createDataFrame([(1, [0.0, 0.5, 2.0]), (2, []), (3, None)], "i int, ev array<double>")
    got = {r.i: r.f for r in S.with_diagnostics(df, "ev", "f").collect()}
    ev = np.array([0.0, 0.5, 2.0])
    raw = [np.exp(-0.5 * ((ev - g) / 0.07) ** 2).sum() for g in np.linspace(0, 2, 32)]
    assert np.allclose(got[1], [*(np.array(raw) / sum(raw)), *(np.exp(-ev * t).mean() for t in np.logspace(-2, 2, 24))])
    assert got[2] == [0.0] * 32 + [None] * 24 and got[3] is None
    assert "transform(" not in plan(registry.queries()["diagnostic_vectors"](spark, SF)).split("ArrowEvalPython")[0]


def test_pairs_send_a_fragment_to_two_blocks(spark):
    p = A.pairs(spark, SF)
    ids = [r.vec_id for r in A.table(spark, SF, "embeddings").select("vec_id").collect()]
    assert {(r.left_id, r.right_id) for r in p.collect()} == {(a, b) for a in ids for b in ids if 0 < b - a <= A.SPAN}
    assert "sequence" not in plan(p)  # twenty copies of each spectrum went through the join


def test_trailing_zeros(spark):
    df = spark.createDataFrame([([0.0, 1.0, 1e-12, 0.0],), ([0.0],), ([],), (None,)], "a array<double>")
    assert [r.s for r in df.select(S.strip_zeros(F.col("a")).alias("s")).collect()] == [[0.0, 1.0, 1e-12], [], [], None]
    assert df.select(S.strip_zeros(F.col("a"), 10).alias("s")).first().s == [0.0, 1.0]


def test_forests_use_all_cores(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("label"), F.lit(1.0).alias("weight"), array_to_vector(F.array((F.col("id") % 2 + F.rand(1)))).alias("features")).coalesce(1)
    scored = L.fit_forest(df, trees=3, depth=2)(df)
    assert scored.rdd.getNumPartitions() >= 8 and scored.count() == 200
    assert L.forest().getCacheNodeIds()  # else each pass walks every tree for every row


def test_clone_forms_are_made_once_a_text(spark):
    p = plan(registry.queries()["clone_type_infer"](spark, SF))
    assert "regexp" not in p.lower()  # the join compares written forms
    df = spark.createDataFrame([("int a; // x", "int b;"), (None, "a"), ("a = 1", "a = 1 # y"), ("(", "+ - *")], "a string, b string")
    assert [r.k for r in df.select(X.clone_type(F.col("a"), F.col("b")).alias("k")).collect()] == [2, 4, 1, 4]


def test_statistics_of_rows(spark):
    """The same as from tables, for chains, loops, repeats and single nodes; nothing is shuffled."""
    rows = [("a", ["x", "y", "z"], [(0, 1), (1, 2), (1, 2), (2, 2)]), ("b", ["x"], []), ("c", ["p", "q"], [(1, 0)])]
    r = spark.createDataFrame(rows, "code_id string, ids array<string>, edges array<struct<src:int,dst:int>>")
    nodes = r.select("code_id", F.posexplode("ids").alias("place", "id")).drop("id")
    edges = r.select("code_id", F.inline("edges"))
    close = lambda a, b: all(x[0] == y[0] and np.allclose(x[1:], y[1:]) for x, y in zip(sorted(map(tuple, a)), sorted(map(tuple, b)), strict=True))
    assert close(C.graph_statistics_of_rows(r).collect(), C.graph_statistics(nodes, edges).collect())
    got = C.message_features_of_rows(r).select("code_id", F.posexplode("features").alias("place", "f")).select("code_id", "place", "f.*")
    key = lambda d: sorted((x.code_id, x.place, *[float(v) for v in x[2:]]) for x in d.collect())
    assert [x[:2] for x in key(got)] == [x[:2] for x in key(C.message_features(nodes, edges))]
    assert np.allclose([x[2:] for x in key(got)], [x[2:] for x in key(C.message_features(nodes, edges))])
    for name in ("graph_statistics", "message_features", "merged_methods"):
        assert "Exchange" not in plan(registry.queries()[name](spark, SF))


def test_methods_merge_in_a_row(spark):
    w = spark.createDataFrame([(1, "t", ["b", "a", "b", "c", "a"]), (2, "t", []), (3, "t", None), (4, "t", ["a"])], "code_id long, layer string, w array<string>").coalesce(1)
    got = {r.code_id: (r.ids, r.methods) for r in G.merge_methods_of_rows(w, 2).collect()}
    assert got == {"1": (["a", "b", "c"], [2, 1, 1]), "2": ([], []), "3": ([], []), "4": (["a"], [0])}


def test_hardness_takes_texts_apart_once(spark):
    assert "regexp" not in plan(registry.queries()["pair_hardness"](spark, SF)).lower()


def test_small_parts_share_tasks(spark, tmp_path):
    """Ten thousand parts of a kilobyte are few tasks, with every row once; few parts keep a task each."""
    got = archives.together([(1 << 10, i) for i in range(10_000)])
    assert len(got) <= 70 and [x for p in got for x in p.parts] == list(range(10_000))
    assert [p.parts for p in archives.together([(5, 0), (1 << 30, 1), (5, 2)])] == [[0], [1], [2]] and archives.together([]) == []
    df = spark.range(1000).select("id", F.repeat(F.lit("é\n"), F.col("id").cast("int") % 9).alias("s")).coalesce(1)
    archives.write_parquet_zips(df, f"{tmp_path}/z", "rows", 2)
    archives.write_dumps(df, f"{tmp_path}/d", "t", entry_rows=2)
    for got in (archives.read_parquet_zip(spark, f"{tmp_path}/z", "^rows"), archives.read_dump(spark, f"{tmp_path}/d", "t", ["id", "s"])):
        assert got.rdd.getNumPartitions() <= 130 and sorted((int(r.id), r.s) for r in got.collect()) == sorted(map(tuple, df.collect()))


def test_ranges_read_little_more_than_themselves(tmp_path):
    import io

    class Counted(io.BytesIO):
        n = 0

        def read(self, k=-1):
            out = super().read(k)
            self.n += len(out)
            return out

    text = b"".join(b"%d %s\n" % (i, b"x" * (i % 300)) for i in range(20_000))
    raw, got, step = Counted(text), [], 1 << 14
    for a in range(0, len(text), step):
        got += [x for lines in archives._range_lines(raw, a, min(len(text), a + step)) for x in lines]
    assert got == text.split(b"\n")[:-1] and raw.n < 2 * len(text)


def test_archives_are_written_where_rows_are_read(spark, monkeypatch):
    from pairwright.plans import trips

    for name in ("write_parquet_zips", "write_dumps"):
        real = getattr(archives, name)
        monkeypatch.setattr(archives, name, lambda df, *a, real=real, **k: (_unshuffled(df), real(df, *a, **k))[1])
    assert trips.archived_documents(spark, SF).count() == A.table(spark, SF, "documents").count()
    trips.dumped_snippets(spark, SF)


def _unshuffled(df):
    assert "Exchange" not in plan(df)


def test_trials_meet_pairs_once(spark, monkeypatch):
    tags, real = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, tag: (tags.append(tag), real(df, tag))[1])
    df = spark.range(400).select((F.col("id") % 20).alias("left_id"), (100 + F.col("id") % 19).alias("right_id"), (F.col("id") % 2).cast("int").alias("label"))
    P.code_disjoint_split(df, 1, 3)
    assert tags.count("trials") == 1


def test_edit_distances_hold_a_pair_at_a_time(spark):
    from pyspark.util import PythonEvalType

    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in plan(registry.queries()["edit_similarity"](spark, SF))


def test_long_labels(spark):
    """A label that was matched character by character overflowed the stack."""
    long = "x" * 300_000
    dot = f'digraph "f" {{\n  "1" [label = "CALL, {long}" ]\n"a:b" [ label = <IF, <b>y</b><BR/>z> ]\n c.d[label="q\\"r, s"]\n  1 -> "a:b" [ label = "AST"]\na-b->c\n}}\n'
    g = G.parse_dot(spark.createDataFrame([("k", "ast", dot)], "code_id string, layer string, dot string")).first()
    assert [tuple(n) for n in g.nodes] == [("1", "CALL", f"CALL, {long}"), ("a:b", "IF", "IF, <b>y</b>"), ("c.d", 'q\\"r', 'q\\"r, s')]
    assert [(e.src, e.dst) for e in g.edges] == [("1", "a:b"), ("a-b", "c")]


def test_lookups_sort_no_more_as_tables_grow(spark):
    """Dealt out or not, the same methods, for repeated and missing keys; a task gets about `part` rows."""
    dots = [(k, c, f, o, n) for k, (c, f, o, n) in enumerate([(c, f, o, n) for c in range(60) for f in (None, 7, 100) for o in (0, 1, None) for n in (None, "f", "other")])]
    methods = [(c, 100 * p, p, f"C.{'fg'[p % 2]}{'<duplicate>0' if c % 3 else ''}:int()") for c in range(0, 60, 2) for p in (0, 1, 1)]
    want = []
    for k, c, f, o, n in dots:
        at = lambda i, v: [m[3] for m in methods if m[0] == c and m[i] == v] if v is not None else []  # noqa: B023, E731
        for a in at(1, f) or [None]:
            for b in at(2, o) or [None]:
                want.append((k, a or (b if b and (n is None or b.split(":")[0].replace("<duplicate>0", "").endswith(n)) else None)))
    d = spark.createDataFrame(dots, "dot long, chunk long, first_node long, ordinal int, name string")
    m = spark.createDataFrame(methods, "chunk long, node_id long, place int, full_name string")
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(R.method_of_dot(d, m).select("dot", "method").collect()) == key(want)
    got = R.method_of_dot(d, m, part=50)
    assert plan(got).count("REPARTITION_BY_NUM") == 4 and "ENSURE_REQUIREMENTS" not in plan(got)  # no shuffle besides
    assert key(got.select("dot", "method").collect()) == key(want)
    assert got.rdd.getNumPartitions() == -(-(len(dots) + len(methods)) // 50) > 8


def _roots(edges):
    root = {x: x for e in edges if None not in e for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if None not in (a, b) and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def test_components_of_odd_shapes(spark):
    """Chains in shuffled order, hubs with larger and smaller names than their leaves, loops, repeats and missing ends."""
    rng = np.random.default_rng(5)
    names = [int(x) for x in rng.permutation(500)]
    edges = list(zip(names[:120], names[1:121], strict=False)) + [(max(names[150:180]), x) for x in names[150:180]] + [(min(names[200:230]), x) for x in names[200:230]]
    edges += [(int(a), int(b)) for a, b in rng.choice(names[250:400], (110, 2))] + [(names[400], names[400]), (names[401], names[402]), (names[402], names[401]), (names[401], names[401]), (names[403], None), (None, names[404]), (None, None)]
    for rows, kind in ((edges, "long"), ([tuple(None if x is None else f"n{x}" for x in e) for e in edges], "string")):
        got = T.components(spark.createDataFrame(rows, f"a {kind}, b {kind}")).collect()
        assert len(got) == len({x.node for x in got}) and {x.node: x.root for x in got} == _roots(rows)
    for rows, want in (([(7, 7), (9, 9)], {(7, 7), (9, 9)}), ([], set()), ([(3, None)], set())):
        assert set(map(tuple, T.components(spark.createDataFrame(rows, "a long, b long")).collect())) == want


def test_edges_of_a_component_are_written_once(spark, monkeypatch):
    """Beyond the edges themselves, what is written follows the nodes; before, edges went both ways and met all labels each round."""
    rows, real = [], T.stored

    def counted(df, tag):
        out = real(df, tag)
        rows.append(out.count())
        return out

    monkeypatch.setattr(T, "stored", counted)
    dense = spark.range(90 * 90).select((F.col("id") % 90).alias("a"), (100 + F.expr("id div 90")).alias("b"))
    assert {tuple(x) for x in T.components(dense).collect()} == {(x, 0) for x in [*range(90), *range(100, 190)]}
    assert sorted(rows)[-1] == 8100 and sum(rows) < 8100 + 10 * 180
