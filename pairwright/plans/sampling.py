"""Hash-ranked samples and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as P
from ..sources import adapters as A
from .registry import query

S = f"WITH {A.SQL_SCORED}"
H = "sha256('7:' || doc_id::VARCHAR)"


def _rows(spark, sf_dir):
    return A.scored(spark, sf_dir).select("doc_id", "lang", "source", "label", "score")


@query(f"{S} SELECT doc_id, lang, label FROM scored QUALIFY row_number() OVER (PARTITION BY lang, label ORDER BY {H}, doc_id) <= 5")
def sample_topk_hash(spark, sf_dir):
    return P.top_k(_rows(spark, sf_dir), ["lang", "label"], "doc_id", 5, 7).select("doc_id", "lang", "label")


@query(f"""{S}, n AS (SELECT label, count(*) AS n, (SELECT count(*) FROM scored) AS t FROM scored GROUP BY label)
SELECT doc_id, label FROM scored JOIN n USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY {H}, doc_id) <= CASE WHEN t <= 40 THEN n ELSE greatest(1, round_even(40.0::DOUBLE * n / t, 0)::BIGINT) END""")
def sample_proportional_cap(spark, sf_dir):
    return P.proportional_cap(_rows(spark, sf_dir), "label", "doc_id", 40, 7).select("doc_id", "label")


@query(f"""{S}, c AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM scored)
SELECT doc_id, label FROM scored, c QUALIFY row_number() OVER (PARTITION BY label ORDER BY {H}, doc_id) <= CASE WHEN label = 1 THEN least(p, 60 - least(q, 30)) ELSE least(q, 60 - least(p, 30)) END""")
def sample_balanced(spark, sf_dir):
    return P.balanced(_rows(spark, sf_dir), "label", "doc_id", 60, 7).select("doc_id", "label")


@query(f"""{S}, c AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS q FROM scored), n AS (SELECT *, least(p + q, 60, floor(p / 0.6::DOUBLE)::BIGINT, floor(q / (1 - 0.6::DOUBLE))::BIGINT) AS n FROM c), k AS (SELECT *, least(p, round_even(n * 0.6::DOUBLE, 0)::BIGINT) AS one FROM n)
SELECT doc_id, label FROM scored, k QUALIFY row_number() OVER (PARTITION BY label ORDER BY {H}, doc_id) <= CASE WHEN label = 1 THEN one ELSE least(q, n - one) END""")
def sample_prevalence_cap(spark, sf_dir):
    return P.prevalence_cap(_rows(spark, sf_dir), "label", "doc_id", 60, 0.6, 7).select("doc_id", "label")


@query(f"{S} SELECT doc_id, lang FROM scored QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {H}, doc_id) <= 3")
def stratified_quota(spark, sf_dir):
    return P.exact_quota(_rows(spark, sf_dir), ["lang"], "doc_id", 3, 7).select("doc_id", "lang")


@query(f"""{S}, m AS (SELECT source, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS m FROM scored GROUP BY source)
SELECT doc_id, source, label FROM scored JOIN m USING (source) QUALIFY row_number() OVER (PARTITION BY source, label ORDER BY {H}, doc_id) <= m""")
def sample_matched_cells(spark, sf_dir):
    return P.matched(_rows(spark, sf_dir), ["source"], "label", "doc_id", 7).select("doc_id", "source", "label")


@query(f"""{S}, n AS (SELECT greatest(1, floor(count(*) * 0.25::DOUBLE)::BIGINT) AS m FROM scored WHERE label = 0)
SELECT doc_id, score FROM (SELECT * FROM scored WHERE label = 0), n QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= m""")
def hard_negatives(spark, sf_dir):
    return P.hard_negatives(_rows(spark, sf_dir), "score", "doc_id", 0.25).select("doc_id", "score")


@query("""WITH c AS (SELECT o_custkey AS anchor, o_orderkey AS candidate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT anchor, candidate FROM c WHERE k = (('0x' || substr(sha256(anchor::VARCHAR), 1, 16))::UBIGINT % n::UBIGINT)""")
def stable_choice(spark, sf_dir):
    c = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("anchor"), F.col("o_orderkey").alias("candidate"))
    return P.stable_choice(c, "anchor", ["candidate"]).select("anchor", "candidate")


@query("""WITH w AS (SELECT source, count(*) AS weight FROM documents GROUP BY source), f AS (SELECT source, weight, floor(weight * 97.0::DOUBLE / sum(weight) OVER ()) AS f, round(weight * 97.0::DOUBLE / sum(weight) OVER () - floor(weight * 97.0::DOUBLE / sum(weight) OVER ()), 9) AS r FROM w)
SELECT source, weight, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, source) <= 97 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""")
def quota_largest_remainder(spark, sf_dir):
    w = A.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("weight"))
    return P.largest_remainder(w, "source", "weight", 97)


@query("""WITH w AS (SELECT source, count(*) // 10 AS weight FROM documents GROUP BY source), f AS (SELECT source, weight, floor(weight * 98.0::DOUBLE / sum(weight) OVER ()) AS f, round(weight * 98.0::DOUBLE / sum(weight) OVER () - floor(weight * 98.0::DOUBLE / sum(weight) OVER ()), 9) AS r FROM w)
SELECT source, weight, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, source DESC) <= 98 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""")
def quota_last_of_ties(spark, sf_dir):
    w = A.table(spark, sf_dir, "documents").groupBy("source").agg(F.floor(F.count(F.lit(1)) / 10).alias("weight"))
    return P.largest_remainder(w, "source", "weight", 98, ties="last")


@query("""WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)), t AS (SELECT lang, i, 1003 // n + (i < 1003 % n)::INTEGER AS t FROM l),
f AS (SELECT lang, i, t, unnest([0, 1, 2]) AS j FROM t), r AS (SELECT *, [0.70::DOUBLE, 0.15, 0.15][j + 1] * t AS raw FROM f), g AS (SELECT *, floor(raw) AS w, raw - floor(raw) AS frac, CASE WHEN i % 2 = 0 OR j = 0 THEN j ELSE 3 - j END AS tie FROM r)
SELECT lang, ['train', 'valid', 'test'][j + 1] AS split, (w + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY frac DESC, tie) <= t - sum(w) OVER (PARTITION BY lang) THEN 1 ELSE 0 END)::BIGINT AS target FROM g""")
def bucket_targets(spark, sf_dir):
    """Targets of 1003 pairs over languages and splits (a few rows)."""
    langs = [r.lang for r in A.table(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang").collect()]
    t = P.bucket_targets(1003, len(langs))
    return spark.createDataFrame([(g, s, int(t[i, j])) for i, g in enumerate(langs) for j, s in enumerate(("train", "valid", "test"))], "lang string, split string, target long")


@query(f"""{S}, t AS (SELECT doc_id, score, percent_rank() OVER (PARTITION BY lang ORDER BY score, doc_id) AS p FROM scored) SELECT doc_id, round(p, 6) AS p FROM t WHERE p >= 0.9""")
def top_fraction(spark, sf_dir):
    from pyspark.sql import Window

    p = F.percent_rank().over(Window.partitionBy("lang").orderBy("score", "doc_id"))
    return _rows(spark, sf_dir).withColumn("p", p).where("p >= 0.9").select("doc_id", F.round("p", 6).alias("p"))


_IDS = "p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, (a.label = b.label)::INTEGER AS label FROM embeddings a CROSS JOIN unnest(range(1, 21)) AS u(d) JOIN embeddings b ON b.vec_id = a.vec_id + d)"
_HASH = "sha256('{seed}:' || left_id::VARCHAR || '/' || right_id::VARCHAR)"


@query(f"WITH {_IDS} SELECT left_id, right_id FROM p WHERE label = 0 ORDER BY {_HASH.format(seed=5)}, left_id::VARCHAR || '/' || right_id::VARCHAR LIMIT 50")
def negative_candidates(spark, sf_dir):
    """Random negatives: all candidate pairs less the known positives, drawn by hash; an error if there are fewer than wanted."""
    p = A.pairs(spark, sf_dir).select("left_id", "right_id", "label")
    return P.negatives(p.select("left_id", "right_id"), p.where("label = 1"), 50, 5)


@query(f"""WITH {_IDS}, h AS (SELECT left_id, right_id, {_HASH.format(seed=3)} AS h FROM p WHERE label = 1), f AS (SELECT e, min_by({{'l': left_id, 'r': right_id}}, {{'h': h, 'l': left_id, 'r': right_id}}) AS x FROM (SELECT left_id AS e, * FROM h UNION ALL SELECT right_id, * FROM h) GROUP BY e)
SELECT left_id, right_id FROM h LEFT JOIN (SELECT DISTINCT x.l AS l, x.r AS r FROM f) n ON l = left_id AND r = right_id ORDER BY l IS NULL, h, left_id, right_id LIMIT 100""")
def greedy_cover(spark, sf_dir):
    """A hundred positives that cover most fragments: a pair comes first if no earlier one has one of its ends."""
    return P.greedy_cover(A.pairs(spark, sf_dir).where("label = 1"), 100, 3)


@query(f"""WITH {_IDS}, r AS (SELECT left_id, right_id, row_number() OVER (ORDER BY {_HASH.format(seed=3)}, left_id, right_id) AS k FROM p WHERE label = 0), f AS (SELECT e, min(k) AS f FROM (SELECT left_id AS e, k FROM r UNION ALL SELECT right_id, k FROM r) GROUP BY e),
s AS (SELECT r.*, a.f AS fl, b.f AS fr, sum((a.f = k)::INTEGER + (b.f = k)::INTEGER) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS seen FROM r JOIN f a ON a.e = left_id JOIN f b ON b.e = right_id),
t AS (SELECT coalesce(min(k) FILTER (seen > 60), 1000000000000) AS stop FROM s), h AS (SELECT stop, coalesce(max(seen) FILTER (k < stop), 0) AS have FROM s, t GROUP BY stop),
o AS (SELECT min_by({{'k': k, 'x': CASE WHEN fl < stop THEN right_id ELSE left_id END}}, k) FILTER (k >= stop AND have < 60 AND (fl < stop) <> (fr < stop)) AS o FROM s, h),
i AS (SELECT s.*, stop, o.o.k AS last, (fl < stop AND fr < stop) AS known, (fl < stop OR coalesce(left_id = o.o.x, false)) AND (fr < stop OR coalesce(right_id = o.o.x, false)) AS inside FROM s, h, o)
SELECT left_id, right_id FROM i WHERE k < stop OR inside ORDER BY (k >= stop AND NOT known AND coalesce(k < last, false)), k LIMIT 100""")
def budget_selection(spark, sf_dir):
    """A hundred negatives with at most sixty fragments: what a pass in hash order takes, and then what fits of those passed over."""
    return P.budget_select(A.pairs(spark, sf_dir).where("label = 0"), 100, 60, 3)


@query()
def capacity_quota(spark, sf_dir):
    """Targets of languages and splits, moved within what each cell has."""
    import numpy as np

    d = A.table(spark, sf_dir, "documents").groupBy("lang").agg(*[F.count_if(F.pmod(F.col("doc_id"), F.lit(10)).between(a, b)).alias(s) for s, a, b in (("train", 0, 6), ("valid", 7, 7), ("test", 8, 9))]).orderBy("lang").collect()
    capacity = np.array([[r.train, r.valid, r.test] for r in d])
    each = int(capacity.sum(1).min()) // 2
    wanted = np.array([[each - 2 * (each // 5), each // 5, each // 5]] * len(d))
    got = P.capacity_quotas(wanted, capacity)
    return spark.createDataFrame([(r.lang, *map(int, g)) for r, g in zip(d, got, strict=True)], "lang string, train long, valid long, test long")
