"""Parsed sources: only what a query needs leaves the task that parsed them."""

from pyspark.sql import functions as F

from pairwright.functions import tables
from pairwright.operators import graphs as G
from pairwright.plans import registry

SF = "/root/testdata/sf0.001"
ROWS = [("a", "x = 1\nif x:\n    y = [x, 'b']\n"), ("b", "def (:"), ("c", None), ("d", "z = 2 if q > = 1 else w")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sources(spark):
    return spark.createDataFrame(ROWS, "code_id string, code string").coalesce(1)


def test_sizes_are_those_of_the_graphs(spark):
    want = {(r.code_id, r.layer, r.status, len(r.nodes), len(r.edges)) for r in G.parse_python(sources(spark)).collect()}
    assert {tuple(r) for r in G.graph_sizes(sources(spark)).collect()} == want
    assert "size(nodes" not in plan(registry.queries()["python_graphs"](spark, SF))


def test_sizes_in_sql_are_those_of_the_rows(spark):
    tables.register(spark)
    sources(spark).createOrReplaceTempView("some_sources")
    one = "SELECT code_id, '{x}' AS layer, count_if(part = 'node'), count_if(part = 'edge') FROM some_sources, LATERAL program_graph(code, '{x}') GROUP BY code_id"
    want = {tuple(r) for x in ("ast", "ddg") for r in spark.sql(one.format(x=x)).collect()}
    assert {tuple(r) for r in spark.sql("SELECT code_id, g.* FROM some_sources, LATERAL program_sizes(code, 'ast,ddg') g").collect()} == want
    assert "Aggregate" not in plan(registry.queries()["program_graphs"](spark, SF))


def test_alignments_are_rows(spark):
    shapes = G.syntax_shapes(sources(spark))
    got = {r.code_id: r for r in G.align_ddg_rows(shapes).collect()}
    assert {i: r.status for i, r in got.items()} == {"a": "validated", "b": "source_parse_failed", "c": "validated", "d": "validated"}
    assert (got["a"].ddg_nodes, got["a"].ast_nodes, got["b"].ast_nodes, got["c"].ast_nodes) == (["s0", "s1", "s2"], ["1", "5", "8"], None, [])
    turned = shapes.withColumn("ends", F.concat(F.reverse("ends"), F.slice("ends", 1, 1)))  # the same edges in another order, one twice
    assert {(r.code_id, r.status) for r in G.align_ddg_rows(turned).where("code_id in ('a', 'd')").collect()} == {("a", "validated"), ("d", "validated")}
    other = shapes.withColumn("ends", F.slice("ends", 2, 100))
    assert G.align_ddg_rows(other).where("code_id = 'a'").first().status == "ast_reproduction_mismatch"
    assert "Aggregate" not in plan(registry.queries()["aligned_dependences"](spark, SF))
