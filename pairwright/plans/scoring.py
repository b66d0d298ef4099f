"""Pair scores over spectra, fusion, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spectra as S
from ..sources import adapters as A
from .registry import query, register

W = f"WITH {A.SQL_PAIRS}"

_RESAMPLE = """
s1 AS (SELECT *, ev1[1:len(ev1) - list_position(list_transform(list_reverse(ev1), lambda x: x <> 0), true) + 1] AS a,
                ev2[1:len(ev2) - list_position(list_transform(list_reverse(ev2), lambda x: x <> 0), true) + 1] AS b FROM pairs),
s2 AS (SELECT *, greatest(len(a), len(b)) AS n FROM s1),
s3 AS (SELECT left_id, right_id, label, layer1,
  CASE WHEN len(a) = n THEN a ELSE list_transform(range(0, n), lambda i: a[(floor(i * (len(a) - 1) / (n - 1)::DOUBLE))::INT + 1]
    + (coalesce(a[(floor(i * (len(a) - 1) / (n - 1)::DOUBLE))::INT + 2], a[len(a)]) - a[(floor(i * (len(a) - 1) / (n - 1)::DOUBLE))::INT + 1])
    * (i * (len(a) - 1) / (n - 1)::DOUBLE - floor(i * (len(a) - 1) / (n - 1)::DOUBLE))) END AS a,
  CASE WHEN len(b) = n THEN b ELSE list_transform(range(0, n), lambda i: b[(floor(i * (len(b) - 1) / (n - 1)::DOUBLE))::INT + 1]
    + (coalesce(b[(floor(i * (len(b) - 1) / (n - 1)::DOUBLE))::INT + 2], b[len(b)]) - b[(floor(i * (len(b) - 1) / (n - 1)::DOUBLE))::INT + 1])
    * (i * (len(b) - 1) / (n - 1)::DOUBLE - floor(i * (len(b) - 1) / (n - 1)::DOUBLE))) END AS b FROM s2),
s4 AS (SELECT left_id, right_id, label, layer1, sqrt(list_sum(list_transform(list_zip(a, b), lambda z: pow(z[1] / sqrt(list_sum(list_transform(a, lambda x: x * x))) - z[2] / sqrt(list_sum(list_transform(b, lambda x: x * x))), 2)))) AS d FROM s3),
pss AS (SELECT left_id, right_id, label, layer1, round(least(greatest(exp(-d / 0.1::DOUBLE), 0), 1), 6) AS score FROM s4)"""

PSS_SQL = f"{W}, {_RESAMPLE}"

METRIC_SQL = {
    "wasserstein": f"""{W},
v AS (SELECT left_id, right_id, label, unnest(list_concat(list_transform(ev1, lambda x: {{'x': x, 'w': 1.0::DOUBLE / len(ev1)}}), list_transform(ev2, lambda x: {{'x': x, 'w': -1.0::DOUBLE / len(ev2)}}))) AS e FROM pairs),
g AS (SELECT left_id, right_id, label, e.x AS x, sum(e.w) AS w FROM v GROUP BY ALL),
c AS (SELECT left_id, right_id, label, lead(x) OVER o - x AS dx, sum(w) OVER (PARTITION BY left_id, right_id ORDER BY x) AS f FROM g WINDOW o AS (PARTITION BY left_id, right_id ORDER BY x))
SELECT left_id, right_id, label, round(exp(-sum(abs(f) * coalesce(dx, 0)) / 0.1::DOUBLE), 6) AS score FROM c GROUP BY ALL""",
    "fisher": f"""{W},
m AS (SELECT *, list_avg(ev1) AS m1, list_avg(ev2) AS m2, greatest(list_var_pop(ev1), 1e-12::DOUBLE) AS v1, greatest(list_var_pop(ev2), 1e-12::DOUBLE) AS v2 FROM pairs)
SELECT left_id, right_id, label, round(exp(-sqrt(2 * ln(greatest(1.0::DOUBLE, (v1 + v2 + (m1 - m2) * (m1 - m2)) / (2 * sqrt(v1) * sqrt(v2)))))), 6) AS score FROM m""",
    "heat_kernel": f"""{W},
t AS (SELECT *, unnest([0.1::DOUBLE, 0.5, 1.0, 2.0, 5.0, 10.0]) AS t FROM pairs),
h AS (SELECT left_id, right_id, label, ln(greatest(list_avg(list_transform(ev1, lambda x: exp(-x * t))), 1e-12::DOUBLE)) - ln(greatest(list_avg(list_transform(ev2, lambda x: exp(-x * t))), 1e-12::DOUBLE)) AS d FROM t)
SELECT left_id, right_id, label, round(exp(-sqrt(sum(d * d))), 6) AS score FROM h GROUP BY ALL""",
    "jensenshannon": f"""{W},
g AS (SELECT left_id, right_id, label, ev1, ev2, least(list_min(ev1), list_min(ev2)) AS lo, greatest(list_max(ev1), list_max(ev2)) AS hi, sqrt(list_var_samp(ev1)) * pow(len(ev1), -0.2::DOUBLE) AS w1, sqrt(list_var_samp(ev2)) * pow(len(ev2), -0.2::DOUBLE) AS w2 FROM pairs),
k AS (SELECT left_id, right_id, label, ev1, ev2, w1, w2, lo - 0.05::DOUBLE * (hi - lo) + i * (1.1::DOUBLE * (hi - lo)) / 511 AS spot FROM g, range(512) AS r(i)),
d AS (SELECT left_id, right_id, label, list_avg(list_transform(ev1, lambda v: exp(-0.5::DOUBLE * pow((spot - v) / w1, 2)))) / (w1 * sqrt(2 * pi())) + 1e-12::DOUBLE AS p, list_avg(list_transform(ev2, lambda v: exp(-0.5::DOUBLE * pow((spot - v) / w2, 2)))) / (w2 * sqrt(2 * pi())) + 1e-12::DOUBLE AS q FROM k),
n AS (SELECT left_id, right_id, label, p / sum(p) OVER o AS p, q / sum(q) OVER o AS q FROM d WINDOW o AS (PARTITION BY left_id, right_id))
SELECT left_id, right_id, label, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2)), 6) AS score FROM n GROUP BY ALL""",
    "cosine": f"""{W}
SELECT left_id, right_id, label, round(list_sum(list_transform(list_zip(ev1, ev2), lambda z: coalesce(z[1] * z[2], 0))) / (sqrt(list_sum(list_transform(ev1, lambda x: x * x))) * sqrt(list_sum(list_transform(ev2, lambda x: x * x)))), 6) AS score FROM pairs""",
    "topk_largest": f"""{W},
k AS (SELECT *, least(len(ev1), len(ev2)) AS k FROM pairs)
SELECT left_id, right_id, label, round(1 / (1 + sqrt(list_sum(list_transform(list_zip(ev1[len(ev1) - k + 1:], ev2[len(ev2) - k + 1:]), lambda z: pow(z[1] - z[2], 2))))), 6) AS score FROM k""",
}


def scores(spark, sf_dir, metric: str, k: int | None = None, digits: int = 6):
    """left_id, right_id, label, layer1, score of the pairs at hand."""
    df = S.pair_scores(A.pairs(spark, sf_dir), metric, k)
    return df.select("left_id", "right_id", "label", "layer1", F.round("score", digits).alias("score"))


for _m in ("pss", "wasserstein", "fisher", "heat_kernel", "cosine", "topk_largest", "jensenshannon"):
    register(f"{_m}_score", lambda spark, sf_dir, m=_m: scores(spark, sf_dir, m).drop("layer1"), f"{PSS_SQL} SELECT left_id, right_id, label, score FROM pss" if _m == "pss" else METRIC_SQL.get(_m))


@query(f"""{W}
SELECT left_id, right_id, label, 16 AS k, round(list_sum(list_transform(list_zip(ev1[1:16], ev2[1:16]), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(ev1[1:16], lambda x: x * x))) * sqrt(list_sum(list_transform(ev2[1:16], lambda x: x * x)))), 6) AS score FROM pairs
UNION ALL SELECT left_id, right_id, label, 1, round(CASE WHEN ev1[1] = 0 OR ev2[1] = 0 THEN 0 ELSE 1 END, 6) FROM pairs""")
def prefix_score(spark, sf_dir):
    """The dispatcher takes the prefix of K values before the metric."""
    out = None
    for k in (16, 1):
        df = S.pair_scores(A.pairs(spark, sf_dir), "cosine", k).select("left_id", "right_id", "label", F.lit(k).alias("k"), F.round("score", 6).alias("score"))
        out = df if out is None else out.unionByName(df)
    return out


@query(f"""{PSS_SQL.replace('pss AS (', 'pss AS MATERIALIZED (').replace('pairs AS (', 'pairs AS MATERIALIZED (')}, f AS MATERIALIZED ({METRIC_SQL['fisher'].replace(W + ',', 'WITH', 1)})
SELECT pss.left_id, pss.right_id, pss.label, round((pss.score + f.score) / 2 + 1e-9::DOUBLE, 5) AS score FROM pss JOIN f USING (left_id, right_id)""")
def fused_score(spark, sf_dir):
    """Late fusion: the mean of two scores of a pair."""
    df = S.pair_scores(A.pairs(spark, sf_dir), "pss", out="s1")
    df = S.pair_scores(df, "fisher", out="s2")
    return df.select("left_id", "right_id", "label", F.round((F.round("s1", 6) + F.round("s2", 6)) / 2 + 1e-9, 5).alias("score"))


@query(f"""WITH {A.SQL_SPECTRA}
SELECT code_id, unnest(range(0, 8)) AS place, round(unnest([least(len(ev) / 2000.0::DOUBLE, 10), list_avg(ev), list_stddev_pop(ev), list_min(ev), list_max(ev), list_aggregate(ev, 'quantile_cont', 0.25), list_aggregate(ev, 'quantile_cont', 0.5), list_aggregate(ev, 'quantile_cont', 0.75)]), 6) AS value FROM spectra""")
def eigen_statistics(spark, sf_dir):
    df = A.spectra(spark, sf_dir).withColumn("f", S.eigen_stats(F.col("ev")))
    return df.select("code_id", F.posexplode("f").alias("place", "v")).select("code_id", F.col("place").cast("long").alias("place"), F.round("v", 6).alias("value"))


@query(f"""{W}, x AS (SELECT left_id, right_id, label, list_concat(ev1, list_transform(range(0, 128), lambda i: 0.0::DOUBLE))[1:128] AS a, list_concat(ev2, list_transform(range(0, 128), lambda i: 0.0::DOUBLE))[1:128] AS b FROM pairs)
SELECT left_id, right_id, label, 258 AS n, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) AS sum_difference, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])), 6) AS sum_product,
round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x))) + 1e-8::DOUBLE), 6) AS cosine,
round(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: pow(z[1] - z[2], 2)))), 6) AS distance FROM x""")
def pair_feature_vectors(spark, sf_dir):
    df = A.pairs(spark, sf_dir).withColumn("a", S.padded(F.col("ev1"), 128)).withColumn("b", S.padded(F.col("ev2"), 128))
    df = df.withColumn("f", S.pair_features(F.col("a"), F.col("b")))
    part = lambda a, n: F.round(S.total(F.slice("f", a, n)), 6)
    return df.select("left_id", "right_id", "label", F.size("f").alias("n"), part(1, 128).alias("sum_difference"), part(129, 128).alias("sum_product"), F.round(F.get("f", F.lit(256)), 6).alias("cosine"), F.round(F.get("f", F.lit(257)), 6).alias("distance"))


@query(f"""{W} SELECT left_id, right_id, label, round(1 / (1 + sqrt(list_sum(list_transform(list_zip(list_concat(ev1, list_transform(range(0, 128), lambda i: 0.0::DOUBLE))[1:128], list_concat(ev2, list_transform(range(0, 128), lambda i: 0.0::DOUBLE))[1:128]), lambda z: pow(z[1] - z[2], 2))))), 6) AS score FROM pairs""")
def untrained_score(spark, sf_dir):
    """1 / (1 + distance) of padded vectors."""
    df = A.pairs(spark, sf_dir).withColumn("a", S.padded(F.col("ev1"), 128)).withColumn("b", S.padded(F.col("ev2"), 128))
    return df.select("left_id", "right_id", "label", F.round(1 / (1 + S.norm(F.zip_with("a", "b", lambda x, y: x - y))), 6).alias("score"))


@query(f"""WITH {A.SQL_SPECTRA}, g AS (SELECT code_id, ev, unnest(range(0, 32)) AS i FROM spectra),
d AS (SELECT code_id, i, list_sum(list_transform(ev, lambda x: exp(-0.5::DOUBLE * pow((x - i * 2.0::DOUBLE / 31) / 0.07::DOUBLE, 2)))) AS v FROM g),
h AS (SELECT code_id, unnest(range(0, 24)) AS j, ev FROM spectra)
SELECT code_id, i::INTEGER AS place, round(v / sum(v) OVER (PARTITION BY code_id), 6) AS value FROM d
UNION ALL SELECT code_id, (32 + j)::INTEGER, round(list_avg(list_transform(ev, lambda x: exp(-x * pow(10.0::DOUBLE, -2 + j * 4.0::DOUBLE / 23)))), 6) FROM h""")
def diagnostic_vectors(spark, sf_dir):
    df = S.with_diagnostics(A.spectra(spark, sf_dir), "ev", "f")
    return df.select("code_id", F.posexplode("f").alias("place", "v")).select("code_id", "place", F.round("v", 6).alias("value"))


@query(f"""WITH {A.SQL_SPECTRA}, w AS (SELECT code_id, list_concat(ev, list_transform(range(0, 128), lambda i: 0.0::DOUBLE))[1:128] AS ev FROM spectra), u AS (SELECT code_id, list_transform(ev, lambda x: x / sqrt(list_sum(list_transform(ev, lambda y: y * y)))) AS v FROM w),
e AS (SELECT unnest(v) AS x, unnest(range(0, 128)) AS i FROM u), s AS (SELECT i, sum(x) AS t, sum(x * x) AS q, count(*) AS n FROM e GROUP BY i)
SELECT max(n)::BIGINT AS n, round((sum(t * t) - sum(q)) / (max(n) * (max(n) - 1)), 6) AS mean_cosine FROM s""")
def mean_pair_cosine(spark, sf_dir):
    """Mean cosine of all pairs of unit vectors (padded spectra), from sums by dimension alone."""
    df = A.spectra(spark, sf_dir).withColumn("v", S.padded(F.col("ev"), 128)).withColumn("n", S.norm(F.col("v")))
    e = df.select(F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("i", "x"))
    s = e.groupBy("i").agg(F.sum("x").alias("t"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    return s.agg(n.alias("n"), F.round((F.sum(F.col("t") * F.col("t")) - F.sum("q")) / (n * (n - 1)), 6).alias("mean_cosine"))
