"""Summaries, intervals and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import transfer as X
from ..sources import adapters as A
from .registry import query

S = f"WITH {A.SQL_SCORED}"
_QS = ", ".join(f"round(quantile_cont(score, {q}), 6) AS p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99))


@query(f"{S} SELECT lang, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, min(score) AS least, max(score) AS largest, {_QS}, round(avg((score >= 0.5)::INTEGER::DOUBLE), 6) AS from_50, round(avg((score >= 0.75)::INTEGER::DOUBLE), 6) AS from_75, round(avg((score >= 0.9)::INTEGER::DOUBLE), 6) AS from_90 FROM scored GROUP BY lang")
def distribution_summary(spark, sf_dir):
    qs = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    scores = A.scored(spark, sf_dir)
    g = scores.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("sd"), F.min("score").alias("least"), F.max("score").alias("largest"), *[F.round(F.avg((F.col("score") >= x).cast("double")), 6).alias(f"from_{int(x * 100)}") for x in (0.5, 0.75, 0.9)])
    g = O.same(g, O.quantiles(scores, ["lang"], "score", qs), ["lang"])
    return g.select("*", *[F.round(F.get("q", F.lit(i)), 6).alias(f"p{int(q * 100):02d}") for i, q in enumerate(qs)]).drop("q")


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS least, max(o_totalprice) AS largest FROM orders GROUP BY ALL")
def describe_groups(spark, sf_dir):
    p, o = F.col("o_totalprice"), A.table(spark, sf_dir, "orders")
    middle = O.quantiles(o, ["o_orderpriority"], "o_totalprice", (0.5,)).select("o_orderpriority", F.round(F.get("q", F.lit(0)), 4).alias("median"))
    g = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("sd"), F.min(p).alias("least"), F.max(p).alias("largest"))
    return O.same(g, middle, ["o_orderpriority"])


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, list_transform(range(301), lambda i: i / 300.0::DOUBLE)) AS q FROM lineitem) SELECT unnest(range(301))::INTEGER AS i, round(unnest(q), 4) AS price FROM q""")
def price_quantiles(spark, sf_dir):
    """301 quantiles of all prices by counts of bits, whatever the size of the table."""
    q = O.quantiles(A.table(spark, sf_dir, "lineitem"), [], "l_extendedprice", [i / 300 for i in range(301)], one_task=0)
    return q.select(F.posexplode("q").alias("i", "price")).select("i", F.round("price", 4).alias("price"))


@query("""SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_returnflag, count(*) * 37 // 100 AS w FROM lineitem GROUP BY ALL) USING (l_returnflag)
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY sha256('11:' || l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR), l_orderkey, l_linenumber) <= any_value(w) OVER (PARTITION BY l_returnflag)""")
def stratified_share(spark, sf_dir):
    """37 % of the lines of each flag by least hash; a flag has half of all lines, and no task ranks one."""
    li = A.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    quota = li.groupBy("l_returnflag").agg(F.floor(F.count(F.lit(1)) * 37 / 100).alias("_w"))
    hashed = F.sha2(F.concat(F.lit("11:"), F.concat_ws("/", "l_orderkey", "l_linenumber")), 256)
    return O.draw(li, ["l_returnflag"], hashed, ["l_orderkey", "l_linenumber"], quota, one_task=0)


@query("SELECT o_orderpriority AS arm, o_orderstatus AS condition, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(coalesce(var_samp(o_totalprice), 0), 0) AS variance FROM orders GROUP BY ALL")
def fold_mean_variance(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("condition"), F.col("o_totalprice").alias("v"))
    n = o.groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"))
    return I.finite_mean_var(o, ["arm", "condition"], "v").join(n, ["arm", "condition"]).select("arm", "condition", "n", F.round("mean", 4).alias("mean"), F.round("variance", 0).alias("variance"))


@query(f"""WITH g AS (SELECT o_custkey AS arm, count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY arm HAVING count(*) >= 2), q AS (SELECT *, CASE WHEN n > {len(I.T95) + 1} THEN 1.959964::DOUBLE ELSE {list(I.T95)}[n - 1]::DOUBLE END AS t FROM g)
SELECT arm, n, round(m + 1e-6::DOUBLE, 3) AS mean, round(m - t * s / sqrt(n) + 1e-6::DOUBLE, 3) AS low, round(m + t * s / sqrt(n) + 1e-6::DOUBLE, 3) AS high FROM q""")
def seed_intervals(spark, sf_dir):
    """Student intervals of every arm with two runs or more."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("arm"), F.col("o_totalprice").alias("v"))
    return I.seed_summary(o, ["arm"], "v").select("arm", "n", *[F.round(F.col(c) + 1e-6, 3).alias(c) for c in ("mean", "low", "high")])  # past ties, whatever the order of sums


@query("SELECT o_orderpriority, round(sum(o_totalprice * (o_custkey % 7 + 1)) / sum(o_custkey % 7 + 1), 4) AS mean FROM orders GROUP BY ALL")
def weighted_mean(spark, sf_dir):
    w = F.col("o_custkey") % 7 + 1
    return A.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.sum(F.col("o_totalprice") * w) / F.sum(w), 4).alias("mean"))


@query(f"""{S}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY lang ORDER BY doc_id % 13) + (count(*) OVER (PARTITION BY lang, doc_id % 13) - 1) / 2.0::DOUBLE AS y FROM scored)
SELECT lang, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r GROUP BY lang""")
def spearman_health(spark, sf_dir):
    return M.spearman(A.scored(spark, sf_dir).withColumn("k", F.col("doc_id") % 13), ["lang"], "score", "k").select("lang", "n", F.round("spearman", 6).alias("spearman"))


@query("""WITH h AS (SELECT lang, length(w) AS c, count(*)::DOUBLE AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY ALL),
p AS (SELECT l.lang, c.c, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY l.lang) AS p FROM (SELECT DISTINCT lang FROM h) l CROSS JOIN (SELECT DISTINCT c FROM h) c LEFT JOIN h ON h.lang = l.lang AND h.c = c.c)
SELECT a.lang AS first, b.lang AS second, round(sum(coalesce(CASE WHEN a.p > 0 THEN a.p * log2(2 * a.p / (a.p + b.p)) END, 0) + coalesce(CASE WHEN b.p > 0 THEN b.p * log2(2 * b.p / (a.p + b.p)) END, 0)) / 2, 6) AS divergence FROM p a JOIN p b ON a.c = b.c AND a.lang < b.lang GROUP BY ALL""")
def histogram_divergence(spark, sf_dir):
    """Jensen-Shannon divergence in bits of the languages' word-length histograms."""
    w = A.table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    h = w.groupBy("lang", F.char_length("w").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    t = h.groupBy("lang").agg(F.sum("n").alias("t"))
    p = h.join(t, "lang").select("lang", "c", (F.col("n") / F.col("t")).alias("p"))
    a, b = p.select(F.col("lang").alias("first"), "c", F.col("p").alias("p")), p.select(F.col("lang").alias("second"), "c", F.col("p").alias("q"))
    m = F.col("p") + F.col("q")
    term = F.col("p") * F.log2(2 * F.col("p") / m) + F.col("q") * F.log2(2 * F.col("q") / m)
    common = a.join(b, "c").where("first < second").groupBy("first", "second").agg(F.sum(term - F.col("p") - F.col("q")).alias("x"))
    # what one of the two has alone counts in full: both masses less what is common
    x, y = t.select(F.col("lang").alias("first")), t.select(F.col("lang").alias("second"))
    return x.join(y, F.col("first") < F.col("second")).join(common, ["first", "second"], "left").select("first", "second", F.round((2 + F.coalesce("x", F.lit(0.0))) / 2, 6).alias("divergence"))


@query("""SELECT avg(missing)::DOUBLE <= 0.01 AS passed, round(avg(missing), 6) AS missing FROM (SELECT CASE WHEN e.vec_id IS NULL THEN 1.0::DOUBLE ELSE 0 END AS missing FROM (SELECT vec_id FROM embeddings) d LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 97 <> 0) e USING (vec_id))""")
def coverage_gate(spark, sf_dir):
    """Share of missing spectra of one layer against its limit of one percent."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id")
    j = e.join(e.where("vec_id % 97 <> 0").withColumn("ok", F.lit(1)), "vec_id", "left")
    return j.agg((F.avg(F.col("ok").isNull().cast("double")) <= 0.01).alias("passed"), F.round(F.avg(F.col("ok").isNull().cast("double")), 6).alias("missing"))


def _draws(replicate: str, unit: str, seed: int = 7) -> str:
    """SQL of a unit's draws in a replicate."""
    u = f"(('0x' || substr(sha256('{seed}/' || {replicate}::VARCHAR || '/' || {unit}::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"
    return "CASE " + " ".join(f"WHEN {u} < {p}::DOUBLE THEN {k}" for k, p in enumerate(I.POISSON)) + f" ELSE {len(I.POISSON)} END"


@query(f"""{S}, t AS (SELECT source, sum(((score >= 0.5)::INTEGER = label)::INTEGER - (label = 1)::INTEGER) AS d, count(*) AS n FROM scored GROUP BY source), r AS (SELECT r, sum(({_draws('r', 'source')}) * d)::DOUBLE / nullif(sum(({_draws('r', 'source')}) * n), 0) AS x FROM t, unnest(range(1, 201)) AS u(r) GROUP BY r)
SELECT (SELECT sum(n)::BIGINT FROM t) AS pairs, round((SELECT sum(d)::DOUBLE / sum(n) FROM t), 6) AS difference, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, count(x) AS replicates FROM r""")
def paired_bootstrap(spark, sf_dir):
    d = A.scored(spark, sf_dir).withColumn("a", ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int")).withColumn("b", (F.col("label") == 1).cast("int"))
    g = I.paired_bootstrap(d, "a", "b", "source")
    return g.select("pairs", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high")], "replicates")


@query(f"""{S}, t AS (SELECT source AS p, 'src' || (doc_id % 20)::VARCHAR AS q, doc_id % 5 AS s, sum(((score >= 0.5)::INTEGER = label)::INTEGER - label) AS d, count(*) AS n FROM scored GROUP BY ALL),
v AS (SELECT r, d, n, p, q, {_draws('r', 'p')} AS wp, {_draws('r', 'q')} AS wq, {_draws('r', "('seed/' || s::VARCHAR)")} AS ws FROM t, unnest(range(1, 101)) AS u(r)), w AS (SELECT r, d, n, CASE WHEN p = q THEN wp ELSE wp * wq END * ws AS w FROM v), g AS (SELECT sum(w * d)::DOUBLE / sum(w * n) AS x FROM w GROUP BY r HAVING sum(w * n) > 0)
SELECT (SELECT count(DISTINCT s) FROM t) AS seeds, count(*) AS valid, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM g""")
def cluster_bootstrap(spark, sf_dir):
    d = A.scored(spark, sf_dir).select(F.col("source").alias("left_problem"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("right_problem"), (F.col("doc_id") % 5).alias("seed"), ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int").alias("correct_a"), F.col("label").alias("correct_b"))
    return I.cluster_bootstrap(d).select("seeds", "valid", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


_AUC = "sum(p * (below + q / 2.0::DOUBLE)) / nullif(sum(p) * sum(q), 0)"


@query(f"""{S}, b AS (SELECT doc_id, label, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS b, score AS a FROM scored), e AS (SELECT doc_id, label, 'a' AS side, a AS s FROM b UNION ALL SELECT doc_id, label, 'b', b FROM b),
w AS (SELECT side, r, s, label, {_draws('r', 'doc_id')} AS k FROM e, unnest(range(0, 51)) AS u(r)), v AS (SELECT side, r, s, label, CASE WHEN r = 0 THEN 1 ELSE k END AS w FROM w), g AS (SELECT side, r, s, coalesce(sum(w) FILTER (label = 1), 0)::BIGINT AS p, coalesce(sum(w) FILTER (label <> 1), 0)::BIGINT AS q FROM v GROUP BY ALL),
c AS (SELECT *, sum(q) OVER (PARTITION BY side, r ORDER BY s ROWS UNBOUNDED PRECEDING) - q AS below FROM g), x AS (SELECT side, r, {_AUC} AS auc FROM c GROUP BY side, r), d AS (SELECT r, max(auc) FILTER (side = 'a') - max(auc) FILTER (side = 'b') AS d FROM x GROUP BY r)
SELECT round(max(d) FILTER (r = 0), 6) AS difference, count(d) FILTER (r > 0) AS valid, round(quantile_cont(d, 0.025) FILTER (r > 0), 6) AS low, round(quantile_cont(d, 0.975) FILTER (r > 0), 6) AS high FROM d""")
def auc_difference(spark, sf_dir):
    """Paired difference of two scores' areas, with an interval."""
    s = A.scored(spark, sf_dir).select(F.col("doc_id").alias("id"), "label", F.col("score").alias("a"), (F.col("doc_id") * 7919 % 1000 / 1000).alias("b"))
    return I.auc_difference(s, "a", "b").select(F.round("difference", 6).alias("difference"), "valid", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""{S}, w AS (SELECT lang, r, score AS s, label, {_draws('r', 'doc_id')} AS w FROM scored, unnest(range(1, 51)) AS u(r)), g AS (SELECT lang, r, s, coalesce(sum(w) FILTER (label = 1), 0)::BIGINT AS p, coalesce(sum(w) FILTER (label <> 1), 0)::BIGINT AS q FROM w GROUP BY ALL),
c AS (SELECT *, sum(q) OVER (PARTITION BY lang, r ORDER BY s ROWS UNBOUNDED PRECEDING) - q AS below FROM g), x AS (SELECT lang, r, {_AUC} AS auc FROM c GROUP BY lang, r)
SELECT lang, count(auc) AS valid, round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM x GROUP BY lang""")
def auc_bootstrap(spark, sf_dir):
    return I.auc_bootstrap(A.scored(spark, sf_dir).withColumnRenamed("doc_id", "id"), "lang").select("lang", "valid", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


_B = "CASE WHEN {a} = {b} THEN {a} ELSE least({a}, {b}) || '-' || greatest({a}, {b}) END"
_L = "WITH l AS (SELECT DISTINCT lang AS x FROM documents)"


@query(f"""{_L}, p AS (SELECT [a.x, b.x] AS p FROM l a JOIN l b ON a.x <> b.x UNION ALL SELECT [a.x, b.x, c.x] FROM l a JOIN l b ON a.x <> b.x JOIN l c ON c.x NOT IN (a.x, b.x) UNION ALL SELECT [a.x, b.x, c.x, d.x] FROM l a JOIN l b ON a.x <> b.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x)),
m AS (SELECT p, len(p) - 1 AS hops, unnest(range(0, CASE len(p) WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 4 END))::INTEGER AS reinforced FROM p),
t AS (SELECT *, list_concat([p[1]], list_transform(range(1, hops + 1), lambda i: {_B.format(a='p[i]', b='p[i + 1]')}), list_filter(list_transform(range(1, hops), lambda i: CASE WHEN (reinforced >> (i - 1)::INTEGER) & 1 = 1 THEN p[i + 1] END), lambda v: v IS NOT NULL)) AS tr FROM m)
SELECT 'within' AS kind, x AS path, 0 AS reinforced, x AS train, x AS test FROM l
UNION ALL SELECT 'cross', a.x || '>' || b.x, 0, a.x || ',' || b.x, {_B.format(a='a.x', b='b.x')} FROM l a JOIN l b ON a.x < b.x
UNION ALL SELECT 'bridge' || hops::VARCHAR, array_to_string(p, '>'), reinforced, array_to_string(tr, ','), p[hops + 1] FROM t""")
def transfer_plan(spark, sf_dir):
    return X.plan(A.table(spark, sf_dir, "documents").select(F.col("lang").alias("language")).distinct())


@query("""WITH s AS (SELECT vec_id, vec_id % 4 AS layer, CASE WHEN vec_id % 29 = 0 THEN 'failed' ELSE 'ok' END AS status FROM embeddings WHERE vec_id % 31 <> 0)
SELECT lang, coalesce(layer, -1)::BIGINT AS layer, coalesce(status, 'missing') AS status, count(*) AS n FROM documents LEFT JOIN s ON vec_id = doc_id GROUP BY ALL""")
def graph_coverage(spark, sf_dir):
    """Codes by language, layer and status; those without a spectrum are missing."""
    s = A.table(spark, sf_dir, "embeddings").where("vec_id % 31 <> 0").select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 4).alias("layer"), F.when(F.col("vec_id") % 29 == 0, "failed").otherwise("ok").alias("status"))
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang").join(s, "doc_id", "left")
    return d.groupBy("lang", F.coalesce("layer", F.lit(-1)).alias("layer"), F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT source, lang, count(*) AS n, avg(n_chars) AS v FROM documents GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY v DESC, n DESC, lang) AS k FROM m)
SELECT source, lang, n FROM b WHERE k = 1""")
def best_row(spark, sf_dir):
    """Best row of each group by value, then by size: an argmax, no sort of a group."""
    m = A.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("v"))
    top = m.groupBy("source").agg(F.min_by(F.struct("lang", "n"), F.struct(-F.col("v"), -F.col("n"), F.col("lang"))).alias("x"))
    return top.select("source", "x.lang", "x.n")


@query("""WITH r AS (SELECT o_custkey % 9 AS arm, o_orderkey % 5 AS seed, avg(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT a.arm, a.seed, round(a.v - b.v, 4) AS delta FROM r a JOIN r b ON b.arm = 0 AND b.seed = a.seed WHERE a.arm <> 0""")
def paired_deltas(spark, sf_dir):
    """Every arm's difference to the reference arm, seed by seed."""
    o = A.table(spark, sf_dir, "orders")
    r = o.groupBy((F.col("o_custkey") % 9).alias("arm"), (F.col("o_orderkey") % 5).alias("seed")).agg(F.avg("o_totalprice").alias("v"))
    base = r.where("arm = 0").select("seed", F.col("v").alias("b"))
    return r.where("arm <> 0").join(base, "seed").select("arm", "seed", F.round(F.col("v") - F.col("b"), 4).alias("delta"))
