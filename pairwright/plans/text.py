"""Text functions over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import adapters as A
from ..sources.storage import stored
from .registry import query

_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '/\*[\s\S]*?\*/', ' ', 'g'), '(?m)//[^\n]*?$', ' ', 'g'), '(?m)#[^\n]*?$', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_STRIP.format(c='text')}) AS stripped FROM documents")
def strip_comments(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.strip_comments(F.col("text")), 256).alias("stripped"))


@query(r"""WITH l AS (SELECT doc_id, text, string_split_regex(regexp_replace(text, '(?:\r\n|[\n\r\x0b\x0c])$', ''), '\r\n|[\n\r\x0b\x0c]') AS ls FROM documents)
SELECT doc_id, greatest(1, CASE WHEN text = '' THEN 0 ELSE len(ls) END)::INTEGER AS n_lines, list_max(list_transform(ls, lambda x: length(x)))::INTEGER AS longest, (len(ls) > 40)::INTEGER + (length(text) > 3000)::INTEGER + (list_max(list_transform(ls, lambda x: length(x))) > 800)::INTEGER AS reasons FROM l""")
def line_filter(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.line_count(F.col("text")).alias("n_lines"), F.array_max(F.transform(X.lines(F.col("text")), F.char_length)).alias("longest"), F.size(X.skip_reasons(F.col("text"), 40, 3000, 800)).alias("reasons"))


@query("""WITH t AS (SELECT doc_id, lang, source, list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\sA-Za-z0-9_]')) AS w FROM documents)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def token_jaccard(spark, sf_dir):
    t = A.table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w"))
    b = t.select((F.col("doc_id") - 1).alias("left_id"), F.col("doc_id").alias("right_id"), F.col("w").alias("v"))
    j = t.withColumnRenamed("doc_id", "left_id").join(b, "left_id")
    return j.select("left_id", "right_id", F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query(f"""WITH t AS (SELECT doc_id, text, list_prepend('BEGIN', list_append(list_transform(regexp_extract_all(text, '[A-Za-z_]+|[0-9]+|[^\\sA-Za-z0-9_]'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'NUM' WHEN regexp_matches(x, '^[A-Za-z_]') THEN 'W' || length(x)::VARCHAR ELSE x END), 'END')) AS s FROM documents),
f AS (SELECT doc_id, list_distinct(list_concat(s, list_transform(range(1, len(s)), lambda i: s[i] || '>' || s[i + 1]))) AS f FROM t)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(len(list_intersect(a.f, b.f))::DOUBLE / len(list_distinct(list_concat(a.f, b.f))), 6) AS jaccard FROM f a JOIN f b ON b.doc_id = a.doc_id + 1""")
def token_fingerprint_jaccard(spark, sf_dir):
    """Jaccard of single categories and pairs; words are categories by length here."""
    raw = F.regexp_extract_all("text", F.lit(r"[A-Za-z_]+|[0-9]+|[^\sA-Za-z0-9_]"), F.lit(0))
    stream = F.transform(raw, lambda x: F.when(x.rlike("^[0-9]"), "NUM").when(x.rlike("^[A-Za-z_]"), F.concat(F.lit("W"), F.char_length(x).cast("string"))).otherwise(x))
    t = A.table(spark, sf_dir, "documents").select("doc_id", stream.alias("s")).select("doc_id", F.transform(X.fingerprint(F.col("s")), lambda x: F.xxhash64(x)).alias("f"))
    t = stored(t, "fingerprints")  # once for both sides, as hashes
    b = t.select((F.col("doc_id") - 1).alias("left_id"), F.col("doc_id").alias("right_id"), F.col("f").alias("g"))
    return t.withColumnRenamed("doc_id", "left_id").join(b, "left_id").select("left_id", "right_id", F.round(X.jaccard(F.col("f"), F.col("g")), 6).alias("jaccard"))


@query()
def clone_type_infer(spark, sf_dir):
    """Type of neighbouring documents taken as fragments (lookahead has no counterpart in RE2)."""
    t = stored(A.table(spark, sf_dir, "documents").select("doc_id", X.clone_form(F.col("text")).alias("form")), "forms")  # once for both sides
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("form").alias("other"))
    return t.join(b, "doc_id").select("doc_id", X.clone_type_of(F.col("form"), F.col("other")).alias("clone_type"))


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' Java ' WHEN 1 THEN 'py3' WHEN 2 THEN 'C++' WHEN 3 THEN 'semantic_c#' WHEN 4 THEN 'gnu++' ELSE 'cobol' END AS raw FROM documents),
a AS (SELECT unnest(['java', 'py3', 'c++', 'c#', 'gnu++']) AS k, unnest(['java', 'python', 'cpp', 'csharp', 'cpp']) AS v)
SELECT doc_id, v AS language FROM l LEFT JOIN a ON k = regexp_replace(lower(trim(raw)), '^semantic_', '')""")
def language_normalisation(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, (" Java ", "py3", "C++", "semantic_c#", "gnu++", "cobol"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return A.table(spark, sf_dir, "documents").select("doc_id", X.language(raw, strict=False).alias("language"))


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_linenumber % 4 = 0 THEN '1' ELSE '3' END AS kind, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_quantity / 50 END AS line, l_discount * 10 AS token FROM lineitem)
SELECT count(*) FILTER (kind = '1') AS type1, count(*) FILTER (kind = '3' AND line IS NOT NULL AND least(line, token) >= 0.5 AND least(line, token) < 0.7) AS type3, count(*) FILTER (kind = '3' AND line IS NOT NULL AND least(line, token) < 0.5) AS type4 FROM p""")
def clone_type_predicate(spark, sf_dir):
    """A missing similarity rejects a pair, though `least` would skip it."""
    p = A.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 4 == 0, "1").otherwise("3").alias("kind"), F.when(F.col("l_tax") <= 0.06, F.col("l_quantity") / 50).alias("line"), (F.col("l_discount") * 10).alias("token"))
    return p.agg(*[F.count_if(X.is_requested_type(t, F.col("kind"), F.col("line"), F.col("token"))).alias(f"type{t}") for t in (1, 3, 4)])


@query("""SELECT doc_id, substr(sha256(lang || '/' || doc_id::VARCHAR), 1, 24) AS pair_id, round(('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE, 9) AS fraction FROM documents""")
def hash_functions(spark, sf_dir):
    from ..operators.sampling import hash_fraction

    return A.table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("/", "lang", F.col("doc_id").cast("string")), 256), 1, 24).alias("pair_id"), F.round(hash_fraction(F.col("doc_id").cast("string")), 9).alias("fraction"))


@query(r"""SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS n_lines, length(text)::INTEGER AS n_chars, left(regexp_replace(text, '\s+', ' ', 'g'), 80) AS preview FROM documents""")
def size_preview(spark, sf_dir):
    """Lines counted by line feeds (unlike line_filter) and the first characters on one line."""
    t = F.col("text")
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(t, "\n", -1)).alias("n_lines"), F.char_length(t).alias("n_chars"), F.left(F.regexp_replace(t, r"\s+", " "), F.lit(80)).alias("preview"))


@query()
def lexical_sketch(spark, sf_dir):
    """Hashed parts of every word of every document, in order."""
    return A.table(spark, sf_dir, "documents").select("doc_id", X.lexical_sketches(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("ids"))


_KIND = "CASE length(w) % 4 WHEN 0 THEN w || '_stmt' WHEN 1 THEN 'ast.' || w WHEN 2 THEN w || '_declaration' ELSE w END"
_CASES = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{c}'" for c, p in X.TYPE_PATTERNS)


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), k AS (SELECT {_KIND} AS raw FROM w UNION SELECT unnest(['if_stmt', 'for_statement', 'method_parameter_in', 'println', '', 'return', 'int_literal', 'call_expr', 'none'])), n AS (SELECT raw, trim(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '_') AS t FROM k)
SELECT raw, CASE WHEN t = '' THEN 'Canonical_Unknown' {_CASES} WHEN NOT starts_with(t, 'operator_') THEN 'Call_Expr' ELSE 'Canonical_Unknown' END AS java, CASE WHEN t = '' THEN 'Canonical_Unknown' {_CASES} ELSE 'Canonical_Unknown' END AS other FROM n""")
def canonical_types(spark, sf_dir):
    """Categories of parser types built from every word of the texts, and of some real ones."""
    w = A.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    n = F.char_length("w") % 4
    raw = F.when(n == 0, F.concat("w", F.lit("_stmt"))).when(n == 1, F.concat(F.lit("ast."), "w")).when(n == 2, F.concat("w", F.lit("_declaration"))).otherwise(F.col("w"))
    real = spark.createDataFrame([(x,) for x in ("if_stmt", "for_statement", "method_parameter_in", "println", "", "return", "int_literal", "call_expr", "none")], "raw string")
    kinds = w.select(raw.alias("raw")).unionByName(real).distinct()
    return kinds.select("raw", X.canonical_type(F.col("raw"), F.lit("java")).alias("java"), X.canonical_type(F.col("raw")).alias("other"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey::VARCHAR || ',"o_orderkey":' || o_orderkey::VARCHAR || ',"o_orderstatus":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS fingerprint FROM orders""")
def row_fingerprints(spark, sf_dir):
    """Hash of a row as JSON with sorted names."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return o.select("o_orderkey", X.fingerprint_of(["o_orderstatus", "o_orderkey", "o_custkey"]).alias("fingerprint"))


#: Items up to this number are sent to every task; more are joined by shuffle.
BROADCAST_ITEMS = 50_000


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''")
def exact_contamination(spark, sf_dir):
    """Documents that hold a test item word for word.

    Words inside an item stand between spaces in any text that holds it: its second to fourth (fewer in short items) are
    looked up among the word sequences of the documents, of which only ids are kept; texts are compared for what is found.
    """
    b = A.table(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("item"))
    w = F.split("item", r"\s+")
    b = b.withColumn("k", F.least(F.lit(3), F.size(w) - 2)).withColumn("seed", F.when(F.col("k") > 0, F.array_join(F.slice(w, F.lit(2), F.greatest(F.lit(0), "k")), " ")))
    n = b.count()
    small = lambda d: F.broadcast(d) if n <= BROADCAST_ITEMS else d
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = None
    for k in sorted(r.k for r in b.select("k").distinct().collect()):  # three sizes, and one for items without inner words
        items = b.where(F.col("k") == k)
        if k > 0:
            words = d.select("doc_id", F.split("text", r"\s+").alias("w"))
            grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " ")))
            seen = words.where(F.size("w") >= k).select("doc_id", F.explode(grams).alias("seed"))
            found = seen.join(small(items.select("item_id", "seed")), "seed").select("item_id", "doc_id")
            hits = found.join(d, "doc_id").join(small(items.select("item_id", "item")), "item_id").where(F.contains("text", "item")).select("item_id", "doc_id")
        else:  # one or two words: every text has to be read for them
            hits = d.join(small(items), F.expr("contains(text, item)")).select("item_id", "doc_id")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else d.join(b, F.lit(False)).select("item_id", "doc_id")
