"""Round trips: given tables are written in a format and read back from it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources import archives, readers, writers
from ..sources.storage import numbered, shared_dir
from ..streaming import incremental
from .registry import query


def _path(spark, tag):
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents")
def archived_documents(spark, sf_dir):
    """Documents as Parquet members of ZIP files, one for each task that reads them, of which three columns of five are decoded."""
    d = A.table(spark, sf_dir, "documents")
    path = _path(spark, "archive")
    archives.write_parquet_zips(d, path, "documents", 100)
    return archives.read_parquet_zip(spark, path, "^documents__", ["doc_id", "lang", "text"]).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("SELECT vec_id::VARCHAR AS code_id, len(embedding)::INTEGER AS size, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) + 1e-7::DOUBLE, 4) AS total FROM embeddings")
def latent_bundles(spark, sf_dir):
    """Spectra as NumPy shards of bundles, checked against their manifests."""
    e = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("code_id"), F.sort_array(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("eigenvalues"))
    path = _path(spark, "latent")
    archives.write_latent_zips(e.repartition(2, "code_id"), path, 50)
    total = F.aggregate("eigenvalues", F.lit(0.0), lambda s, x: s + x)
    return archives.read_latent_zip(spark, path).select("code_id", F.size("eigenvalues").alias("size"), F.round(total + 1e-7, 4).alias("total"))


@query("SELECT doc_id::VARCHAR AS doc_id, lang, md5(text) AS digest FROM documents WHERE lang <> 'en'")
def dumped_snippets(spark, sf_dir):
    """Documents of other languages than English, from one table of custom-format database dumps."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    path = _path(spark, "dump")
    archives.write_dumps(d, path, "snippet", "clones", entry_rows=50)
    return archives.read_dump(spark, path, "snippet", ["doc_id", "lang", "text"], "clones").where("lang <> 'en'").select("doc_id", "lang", F.md5("text").alias("digest"))


@query(r"SELECT doc_id, lang, md5(text) AS digest, (length(text) - length(replace(text, chr(10), '')) + (NOT ends_with(text, chr(10)) AND text <> '')::INTEGER)::INTEGER AS line_count, length(text)::INTEGER AS char_count FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def code_lines(spark, sf_dir):
    """Codes as gzipped JSON lines; those with labels are read, and none of them may be missing."""
    path = _path(spark, "codes")
    writers.write_codes(A.codes(spark, sf_dir), path)
    needed = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("code_id"))
    c = readers.read_jsonl(spark, path, "code_id long, code string, language string, line_count int, char_count int", needed)
    c = readers.require_all(c, needed, "code_id")
    return c.select(F.col("code_id").alias("doc_id"), F.col("language").alias("lang"), F.md5("code").alias("digest"), "line_count", "char_count")


_E = f"WITH {A.SQL_ENDPOINTS}"


@query(f"{_E} SELECT split, left_id, right_id, label, count(*) AS n FROM endpoints GROUP BY ALL")
def tab_separated_pairs(spark, sf_dir):
    """Pairs as tab-separated files named by split."""
    e, path = A.endpoints(spark, sf_dir), _path(spark, "tsv")
    out = None
    for split in ("train", "valid", "test"):
        e.where(F.col("split") == split).select(F.concat_ws("\t", "left_id", "right_id", F.col("label").cast("string")).alias("value")).write.text(f"{path}/{split}")
        p = spark.read.text(f"{path}/{split}").withColumn("split", F.lit(split))
        p = p.select("split", F.split("value", "\t", -1).alias("x")).select("split", F.get("x", F.lit(0)).alias("left_id"), F.get("x", F.lit(1)).alias("right_id"), F.get("x", F.lit(2)).cast("int").alias("label"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("split", "left_id", "right_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_E} SELECT split, left_id, right_id, label, CASE WHEN label = 1 THEN 'clone' ELSE 'non_clone' END AS label_name, count(*) AS n FROM endpoints GROUP BY ALL")
def comma_separated_pairs(spark, sf_dir):
    """Pairs with label names and provenance as gzipped CSV; required columns are checked on the way back."""
    path = _path(spark, "csv")
    writers.write_pairs(A.endpoints(spark, sf_dir), path)
    return readers.read_pairs_csv(spark, path).groupBy("split", "left_id", "right_id", "label", "label_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def copied_customers(spark, sf_dir):
    """Customers from the COPY section of a plain dump that has another table's before and after it."""
    c = A.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    n = A.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    body = numbered(c.select(F.concat_ws("\t", *[F.col(x).cast("string") for x in c.columns]).alias("value")), [F.col("value")], "number")
    count = body.count()
    head = spark.createDataFrame([(-2, "COPY nation (a, b) FROM stdin;"), (-1, "\\."), (0, "COPY customer (a, b, c) FROM stdin;"), (count + 1, "\\."), (count + 2, "COPY customer_old (a, b) FROM stdin;"), (count + 500, "\\.")], "number long, value string")
    rest = numbered(n.select(F.concat_ws("\t", *[F.col(x).cast("string") for x in n.columns]).alias("value")), [F.col("value")], "number").withColumn("number", F.col("number") + count + 2)
    lines = head.unionByName(body).unionByName(rest).withColumn("file", F.lit("dump.sql"))
    return readers.read_copy_section(lines, "customer", ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT vec_id, label, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings WHERE vec_id % 3 = 0")
def feature_shards(spark, sf_dir):
    """Features in shards of at most 100 rows with a manifest; needed ids only, all of which must be there."""
    import json

    path = _path(spark, "shards")
    names = [r.shard for r in writers.write_shards(A.table(spark, sf_dir, "embeddings"), path, 100).collect()]  # a row a shard
    text = json.dumps({"format": "spectral_feature_shards_v1", "shards": names})
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = fs.getFileSystem(spark._jsc.hadoopConfiguration()).create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json"))
    out.write(bytearray(text.encode()))
    out.close()
    needed = A.table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select("vec_id")
    return readers.read_feature_shards(spark, path, needed, "vec_id").select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' WHEN doc_id % 3 = 0 THEN 'second' ELSE 'third' END AS store FROM documents")
def first_of_stores(spark, sf_dir):
    """Every document from the first of three overlapping stores that has it."""
    d = A.table(spark, sf_dir, "documents").select("doc_id")
    stores = [d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"), d]
    return readers.first_store([s.withColumn("store", F.lit(n)) for s, n in zip(stores, ("first", "second", "third"), strict=True)], "doc_id")


@query("SELECT n_name AS name, count(*) AS suppliers, max(s_acctbal) AS best FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def result_lists(spark, sf_dir):
    """Result rows as JSON files in folders, found below their root with the file's name."""
    s = A.table(spark, sf_dir, "supplier").join(A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"), "n_regionkey"), "s_nationkey")
    path = _path(spark, "results")
    g = s.groupBy("n_regionkey", "name").agg(F.count(F.lit(1)).alias("suppliers"), F.max("s_acctbal").alias("best"))
    lists = g.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("name", "suppliers", "best"))).alias("value"))
    lists.repartition(5, "n_regionkey").write.option("maxRecordsPerFile", 1).partitionBy("n_regionkey").text(path)
    return readers.read_results(spark, path, "name string, suppliers long, best double").where("source_file is not null").select("name", "suppliers", "best")


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def kept_subset(spark, sf_dir):
    """Programs of a list of ids, written and put in the place of an earlier table."""
    path = _path(spark, "subset")
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    writers.write_subset(d, d.where("doc_id < 10").select("doc_id"), path, "doc_id")
    labels = A.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    writers.replace_table(d.join(labels.distinct(), "doc_id", "left_semi"), path)
    return spark.read.parquet(path).select("doc_id", F.md5("text").alias("digest"))


@query("""WITH s AS (SELECT l_returnflag AS graph_type, (l_linenumber % 3)::INTEGER AS k, l_quantity AS v FROM lineitem)
SELECT graph_type, CASE WHEN k = 0 THEN 'full' ELSE k::VARCHAR END AS k, count(*) AS n, sum(v::BIGINT)::BIGINT AS total FROM s GROUP BY ALL""")
def appended_scores(spark, sf_dir):
    """Scores as CSV folders by graph type, K and metric, from two appended batches."""
    li, path = A.table(spark, sf_dir, "lineitem"), _path(spark, "scores")
    k = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber") % 3)
    s = li.select(F.col("l_returnflag").alias("graph_type"), k.cast("int").alias("k"), F.lit("pss").alias("metric"), F.col("l_orderkey").alias("left_id"), F.col("l_quantity").cast("long").alias("score"))
    for r in (0, 1):
        writers.append_scores(s.where(F.col("left_id") % 2 == r), path)
    return spark.read.option("header", True).csv(path).groupBy("graph_type", "k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("score").cast("long")).alias("total"))


@query(f"{_E}, u AS (SELECT left_id AS code_id, 'left' AS side, label FROM endpoints UNION ALL SELECT right_id, 'right', label FROM endpoints) SELECT code_id, side, label, count(*) AS n FROM u GROUP BY ALL")
def written_endpoints(spark, sf_dir):
    path = _path(spark, "endpoints")
    writers.write_endpoints(A.endpoints(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("code_id", "side", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[({;]') ORDER BY doc_id")
def bracketed_lines(spark, sf_dir):
    """Texts as lines of plain files under a name that promises gzip; documents one of whose lines has a bracket."""
    d, path = A.table(spark, sf_dir, "documents"), _path(spark, "lines")
    one = F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[\r\n\t]", " "))
    d.select(one.alias("value")).write.text(path)
    lines = archives.read_lines(spark, path, 1 << 16).select(F.split("value", "\t", 2).alias("x"))
    return lines.where(F.get("x", F.lit(1)).rlike("[({;]")).select(F.get("x", F.lit(0)).cast("long").alias("doc_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS computed, 2::BIGINT AS seen, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS digest, (length(text) + (doc_id % 3 = 0)::INTEGER)::VARCHAR AS result
FROM (SELECT doc_id, max(text) AS text FROM documents GROUP BY doc_id)""")
def streamed_documents(spark, sf_dir):
    """Extension: documents come twice as files of a stream, a third of them changed; only those are computed again."""
    d = A.table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("text").alias("text"))
    path = _path(spark, "stream")
    prepare = lambda s: s.select(F.col("doc_id"), F.md5("text").alias("digest"), F.col("text").alias("payload"))
    for k, text in enumerate((F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))):
        d.select("doc_id", text.alias("text")).write.mode("append").parquet(f"{path}/in")
        incremental.run_changed(spark, f"{path}/in", "doc_id long, text string", f"{path}/out", f"{path}/state", prepare, lambda x: str(len(x or "")), key="doc_id")
    rows = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
    last = F.max_by(F.struct("digest", "result"), "batch")
    return rows.groupBy("doc_id").agg(F.count_if("fresh").alias("computed"), F.count(F.lit(1)).alias("seen"), last.alias("x")).select("doc_id", "computed", "seen", "x.digest", "x.result")
