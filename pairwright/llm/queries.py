"""Queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, conversation_trie, decontaminate, minhash, mixing, oracles, quality_knn, quality_rules, secret_scan, spelling_variants, substring_dedup, suffix_dedup, token_output, warc
from .common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def tokenizer_path() -> str:
    """The public vocabulary the token files are written with; installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.roundtrip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan, with a ledger of its own."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"), fresh_path(spark, "secrets-ledger"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_mixing, op3_warc, op4_suffix_array_dedup, op5_minhash, op6_quality_rules, op7_chat_format, op8_token_output, op9_quality_classifier, op10_decontamination, op11_conversation_trie, op12_spelling_variants, op13_secret_scan)}


#: Draws that come after the cut, one for each source and round.
_ROUNDS = "".join(f""",
q{k} AS (SELECT src, any_value(target) - sum((whole + x{k}) * z) AS gap FROM n{k} GROUP BY src),
w{k} AS (SELECT src, arg_min(r, {{'far': abs(v - cutat), 'id': coalesce(doc_id, 0), 'r': r}}) AS flip FROM n{k} JOIN q{k} USING (src) WHERE v IS NOT NULL AND abs(gap) > 0 AND abs(gap - CASE WHEN x{k} = 1 THEN -z ELSE z END) <= abs(gap) / 2 GROUP BY src),
n{k + 1} AS (SELECT n{k}.*, CASE WHEN r = flip THEN 1 - x{k} ELSE x{k} END AS x{k + 1} FROM n{k} LEFT JOIN w{k} USING (src))""" for k in range(3))
#: Ranks of ever longer byte strings: equal strings of 2k bytes are equal pairs of strings of k bytes.
_RANKS = "".join(f"""
r{2 * k} AS (SELECT r, i, dense_rank() OVER (ORDER BY v, w) AS v FROM (SELECT r, i, v, lead(v, {k}) OVER (PARTITION BY r ORDER BY i) AS w FROM r{k}) WHERE w IS NOT NULL),""" for k in (1, 2, 4, 8, 16, 32, 64, 128))


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, words FROM w),
win AS (SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(words) - 33)) AS u(i)),
dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM win SEMI JOIN dup USING (h), range(35) AS o(k)),
kept AS (SELECT d.r, d.doc_id, t.p, words[t.p] AS word, g.p IS NOT NULL AS removed
         FROM d, unnest(range(1, len(words) + 1)) AS t(p) LEFT JOIN gone g ON g.r = d.r AND g.p = t.p)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, count(k.p) FILTER (k.removed)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.p) FILTER (NOT k.removed), '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.r = d.r GROUP BY d.r, d.doc_id, d.words""",
        "op2_mixing": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS z FROM documents),
e AS (SELECT *, floor(log2(z + 2) * 64 + 1e-6::DOUBLE)::BIGINT AS m, (('0x' || substr(sha256('17/' || coalesce(doc_id::VARCHAR, 'null') || '/' || src || '/' || z::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM d),
t AS (SELECT src, sum(z)::BIGINT AS s, [1.0::DOUBLE, 2.0, 3.0][(row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY src),
o AS (SELECT *, row_number() OVER q AS k, sum(3 * s) OVER q - 3 * s AS used, sum(w) OVER () - (sum(w) OVER q - w) AS open, sum(s) OVER () AS total, 3 * s / w AS ratio FROM t WINDOW q AS (ORDER BY 3 * s / w, src ROWS UNBOUNDED PRECEDING)),
h AS (SELECT coalesce(min_by((total - used) / open, k) FILTER ((total - used) / open <= ratio), max(ratio)) AS share FROM o),
g AS (SELECT src, s, least((3 * s)::DOUBLE, w * share) AS target FROM t, h),
a AS (SELECT src, m, sum(z) AS z, sum(z * m) AS zm FROM e GROUP BY src, m),
b AS (SELECT *, sum(z) OVER q - z AS sure, sum(zm) OVER (PARTITION BY src) - (sum(zm) OVER q - zm) AS open FROM a WINDOW q AS (PARTITION BY src ORDER BY m DESC ROWS UNBOUNDED PRECEDING)),
c AS (SELECT src, CASE WHEN any_value(target) >= 3 * any_value(s) * (1 - 1e-12::DOUBLE) THEN 1e18::DOUBLE ELSE coalesce(max_by((target - 3 * sure) / open, m) FILTER (open > 0 AND (target - 3 * sure) / open * m < 3), 0) END AS c FROM b JOIN g USING (src) GROUP BY src),
f AS (SELECT r, doc_id, e.src, z, u, s, target, least(3.0::DOUBLE, c * m) AS x FROM e JOIN g USING (src) JOIN c USING (src)),
i AS (SELECT *, floor(x + 1e-9::DOUBLE)::INTEGER AS whole, greatest(0.0::DOUBLE, x - floor(x + 1e-9::DOUBLE)) AS p FROM f),
j AS (SELECT *, CASE WHEN p > 1e-9::DOUBLE AND z > 0 THEN (u / (1 - u)) / (p / (1 - p)) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS v FROM i),
l AS (SELECT *, target - sum(whole * z) OVER (PARTITION BY src) AS rest, CASE WHEN v IS NOT NULL THEN sum(CASE WHEN v IS NOT NULL THEN z ELSE 0 END) OVER (PARTITION BY src ORDER BY v NULLS LAST, coalesce(doc_id, 0), r ROWS UNBOUNDED PRECEDING) END AS run FROM j),
y AS (SELECT src, min(v) FILTER (run > rest) AS edge FROM l GROUP BY src),
n0 AS (SELECT l.*, coalesce((floor(edge * 4096) + least(4095, floor((edge * 4096 - floor(edge * 4096)) * 4096)) / 4096) / 4096, 1.0::DOUBLE) AS cutat, (v IS NOT NULL AND (run <= rest OR (run - z < rest AND 2 * (rest - run + z) > z)))::INTEGER AS x0 FROM l JOIN y USING (src))""" + _ROUNDS + """
SELECT doc_id, z AS size, s AS source_size, target, ((whole + x3) * z)::BIGINT AS taken, (whole + x3)::INTEGER AS copies FROM n3""",
        "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > lead THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > lead THEN lead END AS refers_to FROM m""",
        "op4_suffix_array_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents),
c AS (SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS b FROM d),
r1 AS (SELECT r, i, ('0x' || b)::BIGINT AS v FROM c),{_RANKS}
h AS (SELECT r, i, count(*) OVER (PARTITION BY v, w) > 1 AS hit FROM (SELECT r, i, v, lead(v, 144) OVER (PARTITION BY r ORDER BY i) AS w FROM r256) WHERE w IS NOT NULL),
g AS (SELECT c.r, c.i, c.b, max(CASE WHEN h.hit THEN c.i END) OVER (PARTITION BY c.r ORDER BY c.i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM c LEFT JOIN h ON h.r = c.r AND h.i = c.i),
s AS (SELECT r, i, b, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS first FROM g),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
        "op5_minhash": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT r, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM d, unnest(range(1, len(w) - 3)) AS u(i) UNION ALL SELECT r, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
c AS (SELECT r, h, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY r)::DOUBLE AS n FROM sh GROUP BY r, h),
p AS (SELECT a.r AS x, b.r AS y FROM c a JOIN c b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r HAVING sum(a.c) >= 0.799::DOUBLE * any_value(a.n) AND sum(b.c) >= 0.799::DOUBLE * any_value(b.n)),
e AS (SELECT x, y, a.c AS a, b.c AS b, a.n AS na, b.n AS nb, a.c / b.c AS q FROM p JOIN c a ON a.r = x JOIN c b ON b.r = y AND b.h = a.h),
f AS (SELECT x, y, a, b, na - sum(a) OVER (PARTITION BY x, y ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above, sum(b) OVER (PARTITION BY x, y ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + nb - sum(b) OVER (PARTITION BY x, y) AS below FROM e),
l AS (SELECT x, y FROM f GROUP BY x, y HAVING sum(1 / (above / a + below / b)) >= 0.8::DOUBLE - 1e-9::DOUBLE UNION SELECT min(r) OVER (PARTITION BY t), r FROM d),
u AS (SELECT x AS a, y AS b FROM l WHERE x <> y UNION SELECT y, x FROM l WHERE x <> y),
k(r, root) AS (SELECT r, r FROM d UNION SELECT u.a, k.root FROM k JOIN u ON u.b = k.r WHERE k.root < u.a),
m AS (SELECT r, min(root) AS root FROM k GROUP BY r)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size FROM d JOIN m USING (r)""",
        "op6_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
cov AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM rep, range(8) AS o(k) GROUP BY r),
m AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (r)),
v AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, coalesce(round(n_symbols::DOUBLE / nullif(word_chars, 0), 6), 0) AS symbol_ratio,
      coalesce(round(word_chars::DOUBLE / nullif(n_words, 0), 6), 0) AS word_length, coalesce(round(n_dup_lines::DOUBLE / nullif(n_lines, 0), 6), 0) AS dup_line_ratio, coalesce(round(n_repeat_words::DOUBLE / nullif(n_words, 0), 6), 0) AS repeat_ratio FROM m),
i AS (SELECT lang, source, round(symbol_ratio * 1000000)::BIGINT AS a, round(word_length * 1000000)::BIGINT AS b, round(dup_line_ratio * 1000000)::BIGINT AS c, round(repeat_ratio * 1000000)::BIGINT AS e FROM v WHERE NOT base_failed),
j AS (SELECT *, (1::BIGINT << greatest(0, length(bin(a)) - 11)) AS ua, (1::BIGINT << greatest(0, length(bin(b)) - 11)) AS ub, (1::BIGINT << greatest(0, length(bin(c)) - 11)) AS uc, (1::BIGINT << greatest(0, length(bin(e)) - 11)) AS ue FROM i),
g AS (SELECT lang, source, (a // ua * ua)::DOUBLE / 1000000 AS a, (b // ub * ub)::DOUBLE / 1000000 AS b, (c // uc * uc)::DOUBLE / 1000000 AS c, (e // ue * ue)::DOUBLE / 1000000 AS e FROM j),
q AS (SELECT lang, source, GROUPING(lang, source) AS lvl, count(*) AS n, quantile_disc(a, [0.25, 0.75]) AS a, quantile_disc(b, [0.25, 0.75]) AS b, quantile_disc(c, [0.25, 0.75]) AS c, quantile_disc(e, [0.25, 0.75]) AS e FROM g GROUP BY GROUPING SETS ((lang, source), (lang), ())),
f AS (SELECT v.*, [(coalesce(o.n, 0) * coalesce(o.a[i], 0.0::DOUBLE) + 4 * ((coalesce(t.n, 0) * coalesce(t.a[i], 0.0::DOUBLE) + 4 * z.a[i]) / (coalesce(t.n, 0) + 4))) / (coalesce(o.n, 0) + 4) FOR i IN [1, 2]] AS a, [(coalesce(o.n, 0) * coalesce(o.b[i], 0.0::DOUBLE) + 4 * ((coalesce(t.n, 0) * coalesce(t.b[i], 0.0::DOUBLE) + 4 * z.b[i]) / (coalesce(t.n, 0) + 4))) / (coalesce(o.n, 0) + 4) FOR i IN [1, 2]] AS b, [(coalesce(o.n, 0) * coalesce(o.c[i], 0.0::DOUBLE) + 4 * ((coalesce(t.n, 0) * coalesce(t.c[i], 0.0::DOUBLE) + 4 * z.c[i]) / (coalesce(t.n, 0) + 4))) / (coalesce(o.n, 0) + 4) FOR i IN [1, 2]] AS c, [(coalesce(o.n, 0) * coalesce(o.e[i], 0.0::DOUBLE) + 4 * ((coalesce(t.n, 0) * coalesce(t.e[i], 0.0::DOUBLE) + 4 * z.e[i]) / (coalesce(t.n, 0) + 4))) / (coalesce(o.n, 0) + 4) FOR i IN [1, 2]] AS e
      FROM v LEFT JOIN q o ON o.lvl = 0 AND o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source LEFT JOIN q t ON t.lvl = 1 AND t.lang IS NOT DISTINCT FROM v.lang LEFT JOIN q z ON z.lvl = 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND symbol_ratio <= a[2] + greatest(0.05::DOUBLE, 3 * (a[2] - a[1])) AND word_length <= b[2] + greatest(1.5::DOUBLE, 3 * (b[2] - b[1])) AND word_length >= b[1] - greatest(1.5::DOUBLE, 3 * (b[2] - b[1]))
       AND dup_line_ratio <= c[2] + greatest(0.3::DOUBLE, 3 * (c[2] - c[1])) AND repeat_ratio <= e[2] + greatest(0.1::DOUBLE, 3 * (e[2] - e[1]))) AS kept, symbol_ratio, word_length, dup_line_ratio, repeat_ratio FROM f""",
    } | oracles.SQL
