"""Joins, filters, windows and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators.ordered import numbered_by
from ..sources import adapters as A
from .registry import query

P = f"WITH {A.SQL_PAIRS}"
E = f"WITH {A.SQL_ENDPOINTS}"


def _t(spark, sf_dir, name):
    return A.table(spark, sf_dir, name)


@query(f"{P}, c AS (SELECT doc_id, lang FROM documents) SELECT left_id, right_id, a.lang AS left_language, b.lang AS right_language, CASE WHEN a.lang = b.lang THEN 'mono' ELSE 'cross' END AS kind FROM pairs JOIN c a ON a.doc_id = left_id JOIN c b ON b.doc_id = right_id")
def language_filter(spark, sf_dir):
    """Mono- and cross-language pairs by an attribute of both ends."""
    codes = A.codes(spark, sf_dir).select("code_id", "language")
    p = R.both_ends(A.pairs(spark, sf_dir).select("left_id", "right_id"), codes)
    j = R.attach(p, codes, "language")
    return j.withColumn("kind", F.when(F.col("left_language") == F.col("right_language"), "mono").otherwise("cross"))


@query(f"{P} SELECT left_id, right_id, label FROM pairs WHERE left_id % 3 <> 0 AND right_id % 3 <> 0")
def feature_availability(spark, sf_dir):
    ids = A.spectra(spark, sf_dir).where("code_id % 3 <> 0").select("code_id")
    return R.both_ends(A.pairs(spark, sf_dir).select("left_id", "right_id", "label"), ids)


_IDS = "p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, (a.label = b.label)::INTEGER AS label FROM embeddings a CROSS JOIN unnest(range(1, 21)) AS u(d) JOIN embeddings b ON b.vec_id = a.vec_id + d)"


@query(f"""WITH {_IDS}, i AS (SELECT * FROM p WHERE left_id % 11 <> 0 AND right_id % 11 <> 0 AND left_id % 13 <> 0 AND right_id % 13 <> 0)
SELECT left_id, right_id, label FROM i WHERE (SELECT count(DISTINCT label) FROM i) = 2""")
def informative_spectra(spark, sf_dir):
    """Pairs of spectra that are finite throughout and not all zero (some are made so here); nothing if one class alone is left."""
    spoilt = lambda i, ev: F.when(F.col(i) % 11 == 0, F.transform(ev, lambda x: x * 0)).when(F.col(i) % 13 == 0, F.concat(ev, F.array(F.lit(float("nan"))))).otherwise(F.col(ev))
    p = A.pairs(spark, sf_dir).select("left_id", "right_id", "label", spoilt("left_id", "ev1").alias("a"), spoilt("right_id", "ev2").alias("b"))
    return R.informative_pairs(p, "a", "b").drop("a", "b")


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def validated_left_join(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    if c.groupBy("k").count().where("count > 1").limit(1).count():
        raise ValueError("c_custkey is not unique")
    return o.join(c, "k", "left").select("o_orderkey", F.col("k").alias("o_custkey"), "c_name")


@query(f"WITH {_IDS} SELECT left_id, right_id FROM p WHERE NOT (label = 1 AND left_id % 2 = 0)")
def unknown_pairs(spark, sf_dir):
    """Candidates that are not among the known pairs, which are given the other way round."""
    p = A.pairs(spark, sf_dir).select("left_id", "right_id", "label")
    known = p.where("label = 1 and left_id % 2 = 0").select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))
    return R.unknown_pairs(p.select("left_id", "right_id"), known)


@query("""WITH v AS (SELECT 'text' AS view, doc_id AS id FROM documents UNION ALL SELECT 'label', doc_id FROM labels UNION ALL SELECT 'spectrum', vec_id FROM embeddings)
SELECT id FROM v GROUP BY id HAVING count(DISTINCT view) = 3""")
def common_support(spark, sf_dir):
    """Ids that every view has: texts, labels and spectra."""
    views = {"text": ("documents", "doc_id"), "label": ("labels", "doc_id"), "spectrum": ("embeddings", "vec_id")}
    return R.common_support({name: _t(spark, sf_dir, t).select(F.col(c).alias("id")) for name, (t, c) in views.items()}, "id")


@query("WITH l AS (SELECT DISTINCT lang FROM documents) SELECT a.lang AS left_language, b.lang AS right_language, CASE WHEN a.lang = b.lang THEN a.lang ELSE a.lang || '-' || b.lang END AS configuration FROM l a JOIN l b ON a.lang <= b.lang")
def language_configurations(spark, sf_dir):
    """Unordered pairs of languages, with themselves (a few rows)."""
    d = _t(spark, sf_dir, "documents").select("lang").distinct()
    a, b = d.select(F.col("lang").alias("left_language")), d.select(F.col("lang").alias("right_language"))
    j = a.join(F.broadcast(b), F.col("left_language") <= F.col("right_language"))
    return j.withColumn("configuration", F.when(F.col("left_language") == F.col("right_language"), F.col("left_language")).otherwise(F.concat_ws("-", "left_language", "right_language")))


@query("""WITH x AS (SELECT o_orderkey AS id, o_custkey % 50 AS k, o_totalprice AS v FROM orders)
SELECT id, k FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC, id) = 1""")
def keep_best(spark, sf_dir):
    x = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("k"), F.col("o_totalprice").alias("v"))
    return R.keep_one(x, ["k"], [F.desc("v"), F.col("id")]).select("id", "k")


@query("""WITH u AS (SELECT o_custkey AS k, o_orderkey AS id, 0 AS p FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderkey % 3 <> 0)
SELECT k, id FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY p, id) = 1""")
def ordered_merge(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    return R.ordered_merge([o.where("id % 3 = 0"), o.where("id % 3 <> 0")], ["k"], ["id"])


@query("""SELECT o_orderkey AS id, o_custkey AS store FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 6 = 0 AND NOT o_totalprice < 1000""")
def merged_cache(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("store"), "o_totalprice")
    return R.merge_cache(o.where("id % 4 = 0"), o.where("id % 6 = 0"), "id", F.col("o_totalprice") < 1000).select("id", "store")


@query("""WITH w AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE md5(text) END AS h FROM documents), c AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE md5(text) END AS g FROM documents WHERE doc_id % 2 = 0)
SELECT w.id, coalesce(c.id IS NOT NULL AND (h = g OR h = '' OR g = ''), false) AS reusable FROM w LEFT JOIN c USING (id)""")
def cache_reuse(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("m"))
    w = d.select("id", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("m")).alias("h"))
    c = d.where("id % 2 = 0").select("id", F.when(F.col("id") % 7 == 0, "stale").otherwise(F.col("m")).alias("h"))
    return R.cache_hits(w, c, "id", "h").select("id", "reusable")


@query("""WITH q AS (SELECT list_distinct(quantile_cont(n_chars, [0.0, 0.25, 0.5, 0.75, 1.0])) AS q FROM documents), s AS (SELECT list_sort(q) AS q FROM q)
SELECT doc_id, len(list_filter(q[2:len(q) - 1], lambda e: e < n_chars))::INTEGER AS bin FROM documents, s""")
def quantile_bins(spark, sf_dir):
    return R.quantile_bins(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "bin").select("doc_id", "bin")


@query("""SELECT doc_id, unnest(['bytes', 'chars', 'lines']) AS measure, unnest([strlen(text), length(text), length(text) - length(replace(text, chr(10), ''))])::BIGINT AS value FROM documents""")
def size_unpivot(spark, sf_dir):
    t = F.col("text")
    d = _t(spark, sf_dir, "documents").select("doc_id", F.octet_length(t).cast("long").alias("bytes"), F.char_length(t).cast("long").alias("chars"), (F.size(F.split(t, "\n", -1)) - 1).cast("long").alias("lines"))
    return R.unpivot(d, ["doc_id"], ["bytes", "chars", "lines"])


@query("""SELECT o_orderstatus, round(max(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 4) AS urgent, round(max(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 4) AS low FROM orders GROUP BY ALL""")
def pivot_best(spark, sf_dir):
    p = _t(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.round(F.max("o_totalprice"), 4))
    return p.withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("""WITH h AS (SELECT o_custkey % 40 AS k, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS epoch, o_totalprice AS loss FROM orders),
x AS (SELECT *, first_value(loss) OVER (PARTITION BY k ORDER BY epoch) AS f, min(loss) OVER (PARTITION BY k) AS m, min(loss) OVER (PARTITION BY k ORDER BY epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM h)
SELECT k, min(epoch) FILTER (loss - r <= 0.1::DOUBLE * (f - m))::INTEGER AS plateau FROM x GROUP BY k""")
def loss_plateau(spark, sf_dir):
    return R.plateau(_history(spark, sf_dir).withColumnRenamed("v", "loss"), ["k"], 0.1)


def _history(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("k"), "o_orderkey", F.col("o_totalprice").alias("v"))
    return numbered_by(o, ["k"], [F.col("o_orderkey")], "epoch").withColumn("epoch", F.col("epoch").cast("int")).drop("o_orderkey")


@query("""WITH h AS (SELECT o_custkey % 40 AS k, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS epoch, o_totalprice AS score FROM orders),
u AS (SELECT *, CASE WHEN score > coalesce(max(score) OVER (PARTITION BY k ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e308) THEN 1 ELSE 0 END AS up FROM h),
b AS (SELECT *, max(CASE WHEN up = 1 THEN epoch END) OVER (PARTITION BY k ORDER BY epoch) AS last_up FROM u), s AS (SELECT k, coalesce(min(epoch) FILTER (epoch - last_up >= 4), max(epoch)) AS e FROM b GROUP BY k)
SELECT k, max(epoch) FILTER (up = 1)::INTEGER AS best_epoch, max(e)::INTEGER AS "end" FROM b JOIN s USING (k) WHERE epoch <= e GROUP BY k""")
def early_stopping(spark, sf_dir):
    return R.early_stop(_history(spark, sf_dir).withColumnRenamed("v", "score"), ["k"], 4)


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, o_orderstatus = 'F' AS complete, CASE WHEN o_orderkey % 9 > 0 THEN floor(o_totalprice / 1000) END AS score FROM orders)
SELECT o_orderpriority, o_orderkey, CASE WHEN complete AND score IS NOT NULL THEN rank() OVER (PARTITION BY o_orderpriority, complete AND score IS NOT NULL ORDER BY score DESC) END::INTEGER AS rank FROM r""")
def ranked_runs(spark, sf_dir):
    """Ranks among complete runs with a score; the others are listed without one."""
    r = _t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", (F.col("o_orderstatus") == "F").alias("complete"), F.when(F.col("o_orderkey") % 9 > 0, F.floor(F.col("o_totalprice") / 1000)).alias("score"))
    return R.complete_ranks(r, ["o_orderpriority"], "score").select("o_orderpriority", "o_orderkey", "rank")


@query("SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS row_index, dense_rank() OVER (ORDER BY source)::INTEGER AS source_no FROM documents")
def ordinals(spark, sf_dir):
    """Place within a group, and numbers of the groups from a small table of them."""
    d = _t(spark, sf_dir, "documents").select("source", "doc_id")
    n = d.select("source").distinct().withColumn("source_no", F.row_number().over(Window.orderBy("source")))
    return d.withColumn("row_index", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).join(n, "source")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def counts_with_totals(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []], F.col("l_returnflag"), F.col("l_linestatus")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) FILTER (text = '') AS blank, count(*) FILTER (n_chars < 100) AS short, count(DISTINCT source) AS sources, round(avg((n_chars > 1000)::INTEGER::DOUBLE), 6) AS long_rate FROM documents GROUP BY lang")
def provenance_counters(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("text") == "").alias("blank"), F.count_if(F.col("n_chars") < 100).alias("short"), F.count_distinct("source").alias("sources"), F.round(F.avg((F.col("n_chars") > 1000).cast("double")), 6).alias("long_rate"))


@query(r"""WITH c AS (SELECT doc_id AS id, doc_id % 5 < 2 AS accessor, CASE WHEN doc_id % 5 < 3 THEN false ELSE len(string_split_regex(regexp_replace(text, '(?:\r\n|[\n\r\x0b\x0c])$', ''), '\r\n|[\n\r\x0b\x0c]')) = 1 OR text = '' END AS short FROM documents),
n AS (SELECT a.id AS l, b.id AS r, a.accessor OR b.accessor AS g, a.short AND b.short AS s, coalesce(e1.vec_id, e2.vec_id) IS NOT NULL AND e1.vec_id IS NOT NULL AND e2.vec_id IS NOT NULL AS known FROM c a JOIN c b ON b.id = a.id + 2 LEFT JOIN embeddings e1 ON e1.vec_id = a.id LEFT JOIN embeddings e2 ON e2.vec_id = b.id WHERE NOT (a.id % 10 = 0))
SELECT CASE WHEN g THEN 'accessor' WHEN s THEN 'both_short' WHEN NOT known THEN 'other_filters' ELSE 'kept' END AS reason, count(*) AS n FROM n GROUP BY reason""")
def curated_negatives(spark, sf_dir):
    """Judged negatives less known positives, by the first reason to drop them: an accessor on either side, both texts of one
    line, an end that other filters dropped."""
    d = _t(spark, sf_dir, "documents")
    i = F.col("doc_id") % 5
    code = F.when(i == 0, "int getX() { return x; }").when(i == 1, "void setX(int v) { x = v; }").when(i == 2, "int isX() { if (x) return 1; }").otherwise(F.col("text"))
    codes = d.select(F.col("doc_id").alias("code_id"), X.is_accessor(code).alias("accessor"), ((i > 2) & (X.line_count(F.col("text")) == 1)).alias("short"))
    n = d.select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 2).alias("right_id")).join(d.select(F.col("doc_id").alias("right_id")), "right_id", "left_semi")
    positives = n.where("left_id % 10 = 0").select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))
    kept = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("code_id"))
    return R.curated_negatives(n, positives, codes, kept).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
