"""Threshold choice, classification metrics and breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import thresholds as T
from ..sources import adapters as A
from ..sources.storage import stored
from .registry import query, register
from .scoring import PSS_SQL, scores

_COUNTS = "count(*) FILTER (label = 1 AND score >= {at})::BIGINT AS tp, count(*) FILTER (label <> 1 AND score >= {at})::BIGINT AS fp, count(*) FILTER (label = 1 AND NOT score >= {at})::BIGINT AS fn, count(*) FILTER (label <> 1 AND NOT score >= {at})::BIGINT AS tn"
_METRICS = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END AS f1, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy,
(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 0 ELSE tn::DOUBLE / (tn + fp) END) / 2 AS balanced_accuracy,
(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END + CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE (2 * tn)::DOUBLE / (2 * tn + fp + fn) END) / 2 AS macro_f1,
CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc"""


def _grid(low, high, n):
    return f"SELECT {low}::DOUBLE + i * (({high}::DOUBLE - {low}::DOUBLE) / {n - 1}) AS threshold FROM range({n}) AS r(i)"


def _quantiles(low, high, n, col="score"):
    qs = ", ".join(repr(q) for q in T.linspace(low, high, n))
    return f"SELECT unnest(quantile_cont({col}, [{qs}])) AS threshold FROM s"


_UNIQUE = "SELECT score AS threshold FROM s"
_MID = "SELECT (score + lead(score) OVER (ORDER BY score)) / 2 AS threshold FROM (SELECT DISTINCT score FROM s)"
CANDIDATES = {
    "exact": f"SELECT 0.0::DOUBLE AS threshold UNION SELECT 1.0 UNION {_UNIQUE} UNION {_MID}",
    "coarse_grid": _grid(0.6, 0.95, 15),
    "grid": f"{_grid(0.01, 0.99, 199)} UNION {_quantiles(0, 1, 301)}",
    "grid_float32": f"{_grid(0.01, 0.99, 199)} UNION {_quantiles(0, 1, 201)}",
    "pr_curve_all": f"{_UNIQUE} UNION SELECT nextafter(max(score), 'inf'::DOUBLE) FROM s",
    "pr_curve": _UNIQUE,
    "percentiles": f"SELECT unnest(quantile_cont(score, [{', '.join(repr(i / 100) for i in range(1, 100))}])) AS threshold FROM s",
    "sweep": f"{_UNIQUE} UNION {_MID}",
    "quantiles_half": f"SELECT 0.5::DOUBLE AS threshold UNION {_quantiles(0, 1, 301)}",
    "four_level": f"{_grid(0.01, 0.99, 199)} UNION {_quantiles(0, 1, 201)}",
}


def threshold_sql(source: str, policy: str, metrics) -> str:
    """source defines s(label, score)."""
    p = T.POLICIES[policy]
    at = "nextafter(threshold, '-inf'::DOUBLE)" if p.just_below else "threshold"
    out = []
    for m in metrics:
        rank = [r for r in p.ranking.get(m, (m,)) if r != "auc"]
        order = ", ".join(f'round("{r}", 12) DESC' if p.digits else f'"{r}" DESC' for r in rank)
        out.append(f"""(SELECT '{m}' AS metric, round(threshold, 6) AS threshold, round("{m}", 6) AS best_value, tp, fp, fn, tn FROM pts ORDER BY {order}, threshold {'DESC' if p.largest else 'ASC'} LIMIT 1)""")
    return f"""{source}, cand AS (SELECT DISTINCT threshold FROM ({CANDIDATES[policy]}) WHERE threshold IS NOT NULL),
cnt AS (SELECT threshold, {_COUNTS.format(at=at)} FROM cand CROSS JOIN s GROUP BY threshold),
pts AS (SELECT *, {_METRICS} FROM cnt) {' UNION ALL '.join(out)}"""


def _chosen(df, policy, metrics):
    out, points = None, stored(T.sweep(df, [], T.POLICIES[policy]), "points")  # one sweep for all metrics
    for m in metrics:
        x = T.best_of(points, [], policy, m).select(F.lit(m).alias("metric"), F.round("threshold", 6).alias("threshold"), F.round("best_value", 6).alias("best_value"), "tp", "fp", "fn", "tn")
        out = x if out is None else out.unionByName(x)
    return out


_SCORED = f"WITH {A.SQL_SCORED}, s AS (SELECT label, score FROM scored)"
_SCORED32 = f"WITH {A.SQL_SCORED}, s AS (SELECT label, score::FLOAT::DOUBLE AS score FROM scored)"
for _p in T.POLICIES:
    if _p in ("exact", "sweep"):
        _metrics = ("f1", "accuracy", "precision", "recall")
    else:
        _metrics = tuple(T.POLICIES[_p].ranking)
    register(f"threshold_{_p}", lambda spark, sf_dir, p=_p, ms=_metrics: _chosen(A.scored(spark, sf_dir), p, ms), threshold_sql(_SCORED32 if _p == "grid_float32" else _SCORED, _p, _metrics))


# distinct scores with running counts; midpoints repeat the counts of the score above them
_RUNNING = f"""{PSS_SQL}, u AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM pss GROUP BY score UNION ALL SELECT v, 0, 0 FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) AS e(v) WHERE v NOT IN (SELECT score FROM pss)),
r AS (SELECT threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS pp, (sum(n) OVER ())::BIGINT AS nn FROM u WINDOW w AS (ORDER BY threshold DESC)),
pts AS (SELECT *, {_METRICS} FROM (SELECT threshold, tp, fp, pp - tp AS fn, nn - fp AS tn FROM r))"""


@query(_RUNNING + " UNION ALL ".join(f"""(SELECT '{m}' AS metric, round(threshold, 6) AS threshold, round("{m}", 6) AS best_value, tp, fp, fn, tn FROM pts ORDER BY "{m}" DESC, threshold DESC LIMIT 1)""" for m in ("f1", "accuracy")).join([" ", ""]))
def threshold_tune(spark, sf_dir):
    """Exact threshold over the pair scores, which are computed once."""
    return _chosen(stored(scores(spark, sf_dir, "pss"), "scores"), "exact", ("f1", "accuracy"))


@query(f"""{_RUNNING}, c AS (SELECT threshold FROM pts ORDER BY f1 DESC, threshold DESC LIMIT 1),
g AS (SELECT CASE WHEN GROUPING(layer1) = 1 THEN 'ALL' ELSE layer1::VARCHAR END AS scope, {_COUNTS.format(at='threshold')} FROM pss, c GROUP BY GROUPING SETS ((layer1), ()))
SELECT scope, tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM (SELECT *, {_METRICS} FROM g)""")
def language_breakdown(spark, sf_dir):
    """The chosen threshold applied to all pairs: a row for each group and one for all."""
    df = stored(scores(spark, sf_dir, "pss"), "scores")
    chosen = T.best(df, [], "pr_curve", "f1")
    rows = T.apply(df, chosen, [])
    cube = rows.groupingSets([[F.col("layer1")], []], F.col("layer1")).agg(F.grouping("layer1").alias("g"), F.count_if(F.expr("label = 1 and predicted = 1")).alias("tp"), F.count_if(F.expr("label <> 1 and predicted = 1")).alias("fp"), F.count_if(F.expr("label = 1 and predicted = 0")).alias("fn"), F.count_if(F.expr("label <> 1 and predicted = 0")).alias("tn"))
    cube = cube.withColumn("scope", F.when(F.col("g") == 1, "ALL").otherwise(F.col("layer1").cast("string")))
    return M.with_metrics(cube, ("precision", "recall", "f1", "accuracy"), 6).drop("layer1", "g")


@query(f"""WITH {A.SQL_SCORED}, x AS (SELECT source, label, (score >= 0.5)::INTEGER AS predicted FROM scored),
c AS (SELECT source, count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label <> 1 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label <> 1 AND predicted = 0) AS tn FROM x GROUP BY source)
SELECT source, tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1, round(mcc, 6) AS mcc FROM (SELECT *, {_METRICS} FROM c)""")
def confusion_metrics(spark, sf_dir):
    df = A.scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return M.with_metrics(M.confusion(df, ["source"]), None, 6)


_AUC = """SELECT {key}, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label <> 1), 0), 6) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY score) + (count(*) OVER (PARTITION BY {key}, score) - 1) / 2.0::DOUBLE AS r FROM scored) GROUP BY {key}"""


@query(f"WITH {A.SQL_SCORED} {_AUC.format(key='lang')}")
def roc_auc(spark, sf_dir):
    return M.roc_auc(A.scored(spark, sf_dir), ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


@query(f"WITH {A.SQL_SCORED} {_AUC.format(key='source')}")
def roc_auc_single_class(spark, sf_dir):
    """Groups of one class have no area (null here)."""
    return M.roc_auc(A.scored(spark, sf_dir), ["source"]).select("source", F.round("auc", 6).alias("auc"))


@query(f"""WITH {A.SQL_SCORED}, t AS (SELECT lang, score, count(*) FILTER (label = 1) AS p, count(*) AS m FROM scored GROUP BY ALL),
c AS (SELECT lang, p, sum(p) OVER w AS tp, sum(m) OVER w AS seen FROM t WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, round(sum(p * tp::DOUBLE / seen) / nullif(sum(p), 0), 6) AS average_precision FROM c GROUP BY lang""")
def average_precision(spark, sf_dir):
    return M.average_precision(A.scored(spark, sf_dir), ["lang"]).select("lang", F.round("average_precision", 6).alias("average_precision"))


@query(f"""WITH {A.SQL_SCORED}, v AS (SELECT * FROM scored WHERE doc_id % 2 = 0), c AS (SELECT lang, threshold, {_COUNTS.format(at='threshold')} FROM (SELECT DISTINCT lang AS l, score AS threshold FROM v) JOIN v ON l = lang GROUP BY ALL),
b AS (SELECT lang, threshold FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY (tp + tn)::DOUBLE / (tp + fp + fn + tn) DESC, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END DESC, threshold DESC) = 1),
g AS (SELECT lang, threshold, {_COUNTS.format(at='threshold')} FROM scored JOIN b USING (lang) WHERE doc_id % 2 = 1 GROUP BY ALL)
SELECT lang, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM (SELECT *, {_METRICS} FROM g)""")
def transfer_evaluation(spark, sf_dir):
    """Thresholds fitted on one part, frozen, and applied to the held-out part of each group."""
    df = A.scored(spark, sf_dir)
    chosen = T.best(df.where("doc_id % 2 = 0"), ["lang"], "pr_curve", "accuracy")
    rows = T.apply(df.where("doc_id % 2 = 1"), chosen, ["lang"])
    counts = M.confusion(rows, ["lang", "threshold"])
    return M.with_metrics(counts, ("f1", "accuracy"), 6).withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH {A.SQL_SCORED}, n AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored),
a AS (SELECT doc_id, label, floor((row_number() OVER (ORDER BY sha256('42:' || doc_id::VARCHAR)) - 1) / least(p, n))::BIGINT AS fold FROM scored, n WHERE label = CASE WHEN p >= n THEN 1 ELSE 0 END),
f AS (SELECT fold, count(*) AS take FROM a GROUP BY fold),
b AS (SELECT doc_id, label, fold FROM (SELECT doc_id, label, fold, take, row_number() OVER (PARTITION BY fold ORDER BY sha256('42:' || fold::VARCHAR || ':' || doc_id::VARCHAR)) AS k FROM scored, n, f WHERE label <> CASE WHEN p >= n THEN 1 ELSE 0 END) WHERE k <= take)
SELECT doc_id, label, fold FROM a UNION ALL SELECT doc_id, label, fold FROM b""")
def balanced_folds(spark, sf_dir):
    return T.balanced_folds(A.scored(spark, sf_dir), "doc_id").select("doc_id", "label", "fold")


@query()
def balanced_evaluation(spark, sf_dir):
    """Thresholds of the balanced folds; counts pooled."""
    return T.balanced_evaluation(A.scored(spark, sf_dir), "doc_id")


@query(f"""WITH {A.SQL_SCORED} SELECT lang, CASE WHEN count(*) FILTER (label = 1) = count(*) FILTER (label = 0) THEN 'accuracy' ELSE 'f1' END AS metric FROM scored GROUP BY lang""")
def selection_metric(spark, sf_dir):
    return T.selection_metric(A.scored(spark, sf_dir), ["lang"])


@query(f"""WITH {A.SQL_SCORED}, t AS (SELECT source AS kind, label, (score >= 0.5)::INTEGER AS predicted FROM scored), k AS (SELECT DISTINCT kind FROM t WHERE label = 1),
x AS (SELECT kind, label, predicted FROM t WHERE label = 1 UNION ALL SELECT k.kind, 0, t.predicted FROM k, t WHERE t.label = 0),
c AS (SELECT kind, count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM x GROUP BY kind)
SELECT kind, tp, fp, fn, tn, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {_METRICS} FROM c)""")
def clone_type_report(spark, sf_dir):
    """Each type's positives together with all negatives: the negatives are counted once."""
    df = A.scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    pos = df.where("label = 1").groupBy(F.col("source").alias("kind")).agg(F.count_if(F.col("predicted") == 1).alias("tp"), F.count_if(F.col("predicted") == 0).alias("fn"))
    neg = df.where("label = 0").agg(F.count_if(F.col("predicted") == 1).alias("fp"), F.count_if(F.col("predicted") == 0).alias("tn"))
    return M.with_metrics(pos.crossJoin(F.broadcast(neg)), ("recall", "f1"), 6).select("kind", "tp", "fp", "fn", "tn", "recall", "f1")


@query(f"""WITH {A.SQL_SCORED}, k AS (SELECT unnest(['src0', 'src1', 'src2', 'none']) AS kind)
SELECT kind, count(doc_id) AS n, coalesce(round(avg((score >= 0.5)::INTEGER::DOUBLE), 6), 0) AS rate FROM k LEFT JOIN scored ON source = kind GROUP BY kind""")
def success_by_type(spark, sf_dir):
    """Rate of positive predictions by type; a type without rows has 0 of 0."""
    kinds = spark.createDataFrame([("src0",), ("src1",), ("src2",), ("none",)], "kind string")
    df = A.scored(spark, sf_dir)
    return F.broadcast(kinds).join(df, F.col("kind") == F.col("source"), "left").groupBy("kind").agg(F.count("doc_id").alias("n"), F.coalesce(F.round(F.avg((F.col("score") >= 0.5).cast("double")), 6), F.lit(0.0)).alias("rate"))


@query(f"""WITH {A.SQL_SCORED}, g AS (SELECT lang, avg(score) FILTER (label = 1) AS m1, avg(score) FILTER (label = 0) AS m0, var_samp(score) FILTER (label = 1) AS v1, var_samp(score) FILTER (label = 0) AS v0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM scored GROUP BY lang),
p AS (SELECT *, ((n1 - 1) * coalesce(v1, 0) + (n0 - 1) * coalesce(v0, 0)) / (n1 + n0 - 2) AS pooled FROM g)
SELECT lang, round(CASE WHEN pooled > 0 THEN (m1 - m0) / sqrt(pooled) ELSE 0 END, 6) AS cohens_d FROM p""")
def effect_size(spark, sf_dir):
    """Cohen's d with the pooled sample variance."""
    one = lambda f, y: f(F.when(F.col("label") == y, F.col("score")))
    g = A.scored(spark, sf_dir).groupBy("lang").agg(one(F.avg, 1).alias("m1"), one(F.avg, 0).alias("m0"), F.coalesce(one(F.var_samp, 1), F.lit(0.0)).alias("v1"), F.coalesce(one(F.var_samp, 0), F.lit(0.0)).alias("v0"), F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    return g.withColumn("pooled", pooled).select("lang", F.round(F.when(F.col("pooled") > 0, (F.col("m1") - F.col("m0")) / F.sqrt("pooled")).otherwise(0.0), 6).alias("cohens_d"))
