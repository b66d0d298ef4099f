"""Filters, guarded joins, samples and run choices over program records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import sampling as P
from ..sources import adapters as A
from ..sources.storage import stored
from .registry import query

S = f"WITH {A.SQL_SCORED}"
E = f"WITH {A.SQL_ENDPOINTS}"
_LINES = r"l AS (SELECT doc_id, CASE WHEN text = '' THEN 1 ELSE len(string_split_regex(regexp_replace(text, '(?:\r\n|[\n\r\x0b\x0c])$', ''), '\r\n|[\n\r\x0b\x0c]')) END AS n FROM documents)"


def _docs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents")


def _neighbours(spark, sf_dir):
    """Every document with the next one."""
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"))


@query(f"WITH {_LINES} SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM l a JOIN l b ON b.doc_id = a.doc_id + 1 WHERE a.n BETWEEN 2 AND 40 AND b.n BETWEEN 2 AND 40")
def line_range_pairs(spark, sf_dir):
    codes = _docs(spark, sf_dir).select(F.col("doc_id").alias("code_id"), X.line_count(F.col("text")).alias("lines"))
    return R.within_lines(_neighbours(spark, sf_dir), codes, 2, 40)


_STATUS = "CASE vec_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ok_sparse_topk' WHEN 2 THEN 'failed_exception' ELSE 'ok' END"


def _spectra(spark, sf_dir):
    status = F.when(F.col("code_id") % 5 == 1, "ok_sparse_topk").when(F.col("code_id") % 5 == 2, "failed_exception").when(F.col("code_id") % 5 > 2, "ok")
    return A.spectra(spark, sf_dir).select("code_id", "layer", F.col("ev").alias("eigenvalues"), status.alias("status"))


@query(f"SELECT (vec_id % 4)::INTEGER AS layer, count(*) AS n FROM (SELECT vec_id, {_STATUS} AS status FROM embeddings) WHERE status IS NULL OR status = 'ok' GROUP BY ALL")
def strict_status(spark, sf_dir):
    return _spectra(spark, sf_dir).where(R.strict_status(F.col("status"))).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT vec_id AS code_id, coalesce(status = 'ok_sparse_topk' AND k < 90, false) AS short_in_cache, coalesce((status = 'ok_sparse_topk' AND k < 90) OR status LIKE 'failed%', false) AS short_in_shard FROM (SELECT vec_id, len(embedding) + vec_id % 49 AS k, {_STATUS} AS status FROM embeddings)")
def sparse_sufficiency(spark, sf_dir):
    return _spectra(spark, sf_dir).select("code_id", R.short_spectra(90, ignore_failed=True).alias("short_in_cache"), R.short_spectra(90).alias("short_in_shard"))


@query("SELECT doc_id AS code_id FROM documents WHERE doc_id % 13 <> 0 AND lang <> 'fr' AND trim(text) <> '' AND doc_id % 17 <> 0")
def usable_programs(spark, sf_dir):
    c = _docs(spark, sf_dir).select(F.col("doc_id").alias("code_id"), F.col("text").alias("code"), F.when(F.col("lang") != "fr", F.col("lang")).alias("language"), F.when(F.col("doc_id") % 17 != 0, F.col("source")).alias("problem_id"), (F.col("doc_id") % 13 == 0).alias("is_mutant"))
    return R.usable_programs(c).select("code_id")


_NAMES = ("a.b.run:void()", "<module>.f", "m.<module>", "<operator>.addition", "x.<operator>.plus.y", "A.<init>:void()", "p.q.<operator>x", "helper")
_PATH = "trim(split_part(name, ':', 1))"


@query(f"""WITH m AS (SELECT doc_id, {list(_NAMES)}[doc_id % 8 + 1] AS name FROM documents), p AS (SELECT doc_id, {_PATH} AS path, regexp_extract({_PATH}, '[^.]*$') AS last FROM m)
SELECT doc_id FROM p WHERE last NOT IN ('<global>', '<init>', '<clinit>', '<module>', '<fakeNew>') AND NOT starts_with(path, '<operator>') AND NOT contains(path, '.<operator>.') AND NOT starts_with(last, '<operator>')""")
def user_methods(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return _docs(spark, sf_dir).where(X.is_user_method(name)).select("doc_id")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_linenumber = 3 AS marked FROM lineitem), a AS (SELECT *, bool_or(marked) OVER (PARTITION BY l_orderkey) AS any_marked FROM m)
SELECT l_orderkey, l_linenumber FROM a WHERE marked OR NOT any_marked""")
def record_methods(spark, sf_dir):
    name = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("Wrap.m_"), F.col("l_orderkey").cast("string"), F.lit(":int()"))).otherwise("Wrap.helper:int()")
    return R.record_methods(A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name")), "l_orderkey", "name").drop("name")


@query("""SELECT code_id FROM (SELECT l_orderkey AS code_id, count(DISTINCT l_linenumber % 3) AS n FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey) WHERE n = 3""")
def required_layers(spark, sf_dir):
    g = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("code_id"), F.element_at(F.array(*map(F.lit, ("ast", "cfg", "ddg"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("layer"), F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("int")).otherwise(0).alias("num_nodes"))
    return R.complete_layers(g, ["ast", "cfg", "ddg"])


@query(f"""{E}, k AS (SELECT split, (substr(left_id, 2)::BIGINT % 7 <> 0 AND substr(right_id, 2)::BIGINT % 3 <> 0) AS ok FROM endpoints)
SELECT split, count(*) AS before, count(*) FILTER (ok) AS after, count(*) FILTER (NOT ok) AS removed FROM k GROUP BY split""")
def pruned_pairs(spark, sf_dir):
    e = A.endpoints(spark, sf_dir)
    number = F.substring("code_id", 2, 20).cast("long")
    ids = e.select(F.explode(F.array("left_id", "right_id")).alias("code_id")).distinct().where(F.when(F.startswith("code_id", F.lit("p")), number % 7 != 0).otherwise(number % 3 != 0))
    return R.prune_to_coverage(e, ids)[1]


@query(f"{E} SELECT split, label, count(*) AS source, count(*) FILTER (edge_id % 6 <> 0 OR label = 1) AS retained, count(*) FILTER (NOT (edge_id % 6 <> 0 OR label = 1)) AS dropped FROM endpoints GROUP BY ALL")
def recommended_pairs(spark, sf_dir):
    """Generated negatives that are not recommended go; counters by split and label."""
    ok = (F.col("edge_id") % 6 != 0) | (F.col("label") == 1)
    return A.endpoints(spark, sf_dir).groupBy("split", "label").agg(F.count(F.lit(1)).alias("source"), F.count_if(ok).alias("retained"), F.count_if(~ok).alias("dropped"))


@query("""WITH t AS (SELECT * FROM (VALUES ('web', 'fr', 'ddg', 'overlay fails'), ('forum', 'de', 'cfg', 'no parser')) AS v(dataset, language, layer, reason)), l AS (SELECT unnest(['ast', 'cfg', 'ddg']) AS layer)
SELECT d.source AS dataset, d.lang AS language, l.layer, count(*) AS n, any_value(t.reason) AS reason FROM documents d CROSS JOIN l LEFT JOIN t ON t.dataset = d.source AND t.language = d.lang AND t.layer = l.layer GROUP BY ALL""")
def declared_limitations(spark, sf_dir):
    """Dataset, language and layer with the declared reason why it cannot be produced, if there is one."""
    t = spark.createDataFrame([("web", "fr", "ddg", "overlay fails"), ("forum", "de", "cfg", "no parser")], "dataset string, language string, layer string, reason string")
    g = _docs(spark, sf_dir).groupBy(F.col("source").alias("dataset"), F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("layer", F.explode(F.array(*map(F.lit, ("ast", "cfg", "ddg")))))
    return g.join(F.broadcast(t), ["dataset", "language", "layer"], "left")  # the table is declared in code


@query("""SELECT lang, round(avg((len(list_filter(list_distinct(w), lambda x: x NOT IN ('the', 'a', 'of', 'and'))) = 0)::INTEGER::DOUBLE), 6) AS skeleton_rate
FROM (SELECT lang, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents) GROUP BY lang""")
def skeleton_rate(spark, sf_dir):
    """Share of graphs that have no node types but a fixed few."""
    from ..operators.graphs import skeleton

    w = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    return _docs(spark, sf_dir).groupBy("lang").agg(F.round(F.avg(skeleton(w, ("the", "a", "of", "and")).cast("double")), 6).alias("skeleton_rate"))


@query("SELECT l_orderkey AS code_id, count(*) AS edges FROM (SELECT l_orderkey, l_partkey % 50 - 5 AS s, l_suppkey % 50 - 5 AS d FROM lineitem) WHERE s >= 0 AND d >= 0 AND s < 40 AND d < 40 GROUP BY ALL")
def bounded_edges(spark, sf_dir):
    from ..operators.graphs import bounded_edges as bounded

    e = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("code_id"), (F.col("l_partkey") % 50 - 5).alias("src"), (F.col("l_suppkey") % 50 - 5).alias("dst"))
    return bounded(e, 40).groupBy("code_id").agg(F.count(F.lit(1)).alias("edges"))


@query("""WITH m AS (SELECT l_orderkey AS chunk, l_linenumber - 1 AS place, l_linenumber * 100 AS node_id, 'C.f' || l_linenumber::VARCHAR || CASE WHEN l_linenumber % 2 = 0 THEN '<duplicate>0:int()' ELSE ':int()' END AS full_name FROM lineitem),
d AS (SELECT l_orderkey AS chunk, l_linenumber AS dot, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber * 100 ELSE 7 END AS first_node, l_linenumber - 1 AS ordinal, CASE WHEN l_linenumber = 5 THEN 'other' WHEN l_linenumber = 1 THEN NULL ELSE 'f' || l_linenumber::VARCHAR END AS name FROM lineitem)
SELECT d.chunk, d.dot, coalesce(a.full_name, CASE WHEN d.name IS NULL OR ends_with(regexp_replace(split_part(b.full_name, ':', 1), '<duplicate>[0-9]+$', ''), d.name) THEN b.full_name END) AS method
FROM d LEFT JOIN m a ON a.chunk = d.chunk AND a.node_id = d.first_node LEFT JOIN m b ON b.chunk = d.chunk AND b.place = d.ordinal""")
def method_lookup(spark, sf_dir):
    n = F.col("l_linenumber")
    li = A.table(spark, sf_dir, "lineitem")
    full = F.concat(F.lit("C.f"), n.cast("string"), F.when(n % 2 == 0, "<duplicate>0:int()").otherwise(":int()"))
    m = li.select(F.col("l_orderkey").alias("chunk"), (n - 1).alias("place"), (n * 100).alias("node_id"), full.alias("full_name"))
    d = li.select(F.col("l_orderkey").alias("chunk"), n.alias("dot"), F.when(n % 3 == 0, n * 100).otherwise(7).alias("first_node"), (n - 1).alias("ordinal"), F.when(n == 5, "other").when(n == 1, None).otherwise(F.concat(F.lit("f"), n.cast("string"))).alias("name"))
    return R.method_of_dot(d, m).select("chunk", "dot", "method")


@query(f"""{S}, b AS (SELECT doc_id // 500 AS batch, label, score FROM scored)
SELECT x.batch, count(*) FILTER (a.label = 1) AS pairs, round(coalesce(avg(ln(1 + exp(a.other - a.score))), 0) + 1e-8::DOUBLE, 6) AS loss FROM (SELECT DISTINCT batch FROM b) x LEFT JOIN (SELECT p.batch, p.label, p.score, q.score AS other FROM b p JOIN b q ON q.batch = p.batch AND p.label = 1 AND q.label <> 1) a ON a.batch = x.batch GROUP BY x.batch""")
def ranking_loss(spark, sf_dir):
    """Over all positives and negatives of a batch; a batch is five hundred neighbouring ids."""
    s = A.scored(spark, sf_dir).withColumn("batch", F.expr("doc_id div 500"))
    return R.ranking_loss(s, ["batch"], 16).select("batch", "pairs", F.round(F.col("loss") + 1e-8, 6).alias("loss"))


@query(f"""{E} SELECT split, count(*) AS pairs, count(DISTINCT l) AS codes FROM (SELECT split, 'S_' || left_id AS l FROM endpoints WHERE split <> 'test' UNION ALL SELECT split, 'T_' || left_id FROM endpoints WHERE split = 'test') GROUP BY split""")
def transfer_bundle(spark, sf_dir):
    """Training and validation pairs of one dataset and test pairs of another under tagged ids."""
    e = A.endpoints(spark, sf_dir).select("split", "left_id", "right_id", "label")
    u = R.tagged_union([("S", e.where("split <> 'test'")), ("T", e.where("split = 'test'"))], ["left_id", "right_id"])
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("left_id").alias("codes"))


@query("""WITH t AS (SELECT vec_id AS code_id, unnest(range(0, 4)) AS k, embedding FROM embeddings), s AS (SELECT code_id, 10 + (code_id + k) % 8 AS size, list_transform(embedding[(k * 16 + 1):(k * 16 + 16)], lambda x: x::DOUBLE) AS v FROM t),
m AS (SELECT a.code_id AS left_id, b.code_id AS right_id, max(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) AS c FROM s a JOIN s b ON b.code_id = a.code_id + 1 AND abs(a.size - b.size) / greatest(a.size, 1)::DOUBLE <= 0.2::DOUBLE GROUP BY ALL)
SELECT a.vec_id AS left_id, a.vec_id + 1 AS right_id, round(greatest(0, coalesce(c, 0)), 6) AS similarity FROM embeddings a LEFT JOIN m ON m.left_id = a.vec_id""")
def subtree_match(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    t = e.select(F.col("vec_id").alias("code_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "embedding")
    t = t.select("code_id", (10 + (F.col("code_id") + F.col("k")) % 8).alias("size"), F.transform(F.slice("embedding", F.col("k") * 16 + 1, F.lit(16)), lambda x: x.cast("double")).alias("vector"))
    pairs = e.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    return R.subtree_match(pairs, t).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH t AS (SELECT o_custkey AS code_id, o_orderkey AS root, floor(o_totalprice / 1000)::BIGINT AS size FROM orders)
SELECT code_id, root FROM t QUALIFY row_number() OVER (PARTITION BY code_id ORDER BY size DESC, root) <= 4""")
def largest_subtrees(spark, sf_dir):
    t = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code_id"), F.col("o_orderkey").alias("root"), F.floor(F.col("o_totalprice") / 1000).alias("size"))
    w = Window.partitionBy("code_id").orderBy(F.desc("size"), "root")
    return t.withColumn("k", F.row_number().over(w)).where("k <= 4").select("code_id", "root")


@query("""WITH r AS (SELECT o_custkey % 50 AS identity, o_orderkey AS source, o_orderstatus = 'F' AS complete, o_orderkey % 7 AS h, o_custkey AS steps FROM orders)
SELECT identity, source FROM r QUALIFY row_number() OVER (PARTITION BY identity ORDER BY complete DESC, h DESC, steps DESC, source) = 1""")
def best_snapshot(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    h = F.when(F.col("o_orderkey") % 7 > 0, F.sequence(F.lit(1), (F.col("o_orderkey") % 7).cast("int"))).otherwise(F.array().cast("array<int>"))
    r = o.select((F.col("o_custkey") % 50).alias("identity"), F.col("o_orderkey").alias("source"), (F.col("o_orderstatus") == "F").alias("complete"), h.alias("history"), F.col("o_custkey").alias("steps"))
    return R.best_snapshot(r).select("identity", "source")


@query("""SELECT name, row_number() OVER (ORDER BY CASE name WHEN '3-MEDIUM' THEN 10 WHEN '1-URGENT' THEN 20 ELSE 999 END, name)::INTEGER AS place FROM (SELECT DISTINCT o_orderpriority AS name FROM orders)""")
def ordered_names(spark, sf_dir):
    return R.ordered_names(A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")), "name", {"3-MEDIUM": 10, "1-URGENT": 20})


@query(f"""{S}, c AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS q FROM scored), w AS (SELECT *, greatest(1, least(49, round_even(50.0::DOUBLE * p / (p + q), 0)::BIGINT)) AS want FROM c), z AS (SELECT *, least(50 - least(want, p), q) AS zero FROM w)
SELECT doc_id, label FROM scored, z QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256('9173:' || doc_id::VARCHAR), doc_id) <= CASE WHEN p + q <= 50 THEN p + q WHEN label = 1 THEN 50 - zero ELSE zero END""")
def fixed_sample(spark, sf_dir):
    return P.fixed_sample(A.scored(spark, sf_dir).select("doc_id", "label"), "label", "doc_id", 50, 9173)


@query()
def code_disjoint_split(spark, sf_dir):
    """Balanced pairs of splits that share no code: best of three hash assignments."""
    return P.code_disjoint_split(stored(A.endpoints(spark, sf_dir).groupBy("left_id", "right_id").agg(F.min("label").alias("label")), "pairs"), 5, 3)


@query(f"""{E}, u AS (SELECT DISTINCT split, left_id, right_id, min(label) OVER (PARTITION BY split, left_id, right_id) AS label FROM endpoints WHERE substr(left_id, 2)::BIGINT % 5 <> 0), m AS (SELECT split, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS m FROM u GROUP BY split)
SELECT split, left_id, right_id, label FROM u JOIN m USING (split) QUALIFY row_number() OVER (PARTITION BY split, label ORDER BY sha256('3:' || left_id || '/' || right_id), left_id || '/' || right_id) <= m""")
def coverage_balance(spark, sf_dir):
    e = A.endpoints(spark, sf_dir).groupBy("split", "left_id", "right_id").agg(F.min("label").alias("label"))
    ids = e.select(F.explode(F.array("left_id", "right_id")).alias("code_id")).where("not (startswith(code_id, 'p') and cast(substring(code_id, 2) as bigint) % 5 = 0)")
    return P.balance_to_coverage(e, ids, 3).select("split", "left_id", "right_id", "label")


@query("""WITH s AS (SELECT vec_id AS id, vec_id % 2 AS label, vec_id % 6 <> 1 AS kept FROM embeddings), m AS (SELECT least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS m, greatest(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS g FROM s WHERE kept), o AS (SELECT count(*) FILTER (label = 1) = count(*) FILTER (label = 0) AS even FROM s)
SELECT id, label FROM s, m, o WHERE kept QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= CASE WHEN even THEN m ELSE g END""")
def majority_trim(spark, sf_dir):
    s = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 2).alias("label"))
    return P.trim_majority(s.where("id % 6 <> 1"), s, "label", "id")


@query(r"""SELECT doc_id, regexp_matches(code, '(?m)^\s*(?:package\s+[\w.]+\s*;|import\s+[\w.*]+\s*;|(?:public\s+)?(?:abstract\s+|final\s+)?(?:class|interface|enum|record)\s+\w+)') AS java,
regexp_matches(code, '(?m)^\s*(?:using\s+[\w.]+\s*;|namespace\s+[\w.]+|(?:public\s+)?(?:abstract\s+|sealed\s+|static\s+)?(?:class|interface|struct|enum|record)\s+\w+)') AS csharp
FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || '  import a.b.*;' WHEN 1 THEN chr(10) || 'public sealed class X' WHEN 2 THEN chr(10) || 'interface Y' ELSE ' class Z' END AS code FROM documents)""")
def unit_detection(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 4 == 0, "\n  import a.b.*;").when(F.col("doc_id") % 4 == 1, "\npublic sealed class X").when(F.col("doc_id") % 4 == 2, "\ninterface Y").otherwise(" class Z")
    d = _docs(spark, sf_dir).select("doc_id", F.concat("text", tail).alias("code"))
    return d.select("doc_id", X.is_unit(F.col("code"), "java").alias("java"), X.is_unit(F.col("code"), "csharp").alias("csharp"))


@query()
def rendered_sources(spark, sf_dir):
    """Documents as method bodies, made to compile by themselves."""
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("public int run(int a) {\n"), "text", F.lit("\n}")).alias("code"), F.when(F.col("doc_id") % 3 == 0, "java").when(F.col("doc_id") % 3 == 1, "csharp").otherwise("python").alias("lang"))
    return d.select("doc_id", "lang", F.sha2(X.rendered_source(F.col("code"), F.col("doc_id").cast("string"), F.col("lang"), F.lit(False)), 256).alias("source"))


@query()
def repaired_operators(spark, sf_dir):
    """Texts whose commas stand for operators that a tokeniser has set apart."""
    d = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", ",", " > =").alias("code"))
    return d.select("doc_id", F.sha2(X.repair_operators(F.col("code")), 256).alias("repaired"), F.regexp_count(X.repair_operators(F.col("code")), F.lit(">=")).alias("joined"))
