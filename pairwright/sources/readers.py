"""Readers of the formats that fragment data comes in. All read through Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import unescape_copy


def read_jsonl(spark: SparkSession, path: str, schema: str, needed: DataFrame | None = None, key: str = "code_id") -> DataFrame:
    """One JSON object a line, blank lines skipped; `needed` restricts to its ids."""
    df = spark.read.schema(schema).json(path)
    return df if needed is None else df.join(needed.select(key).distinct(), key, "left_semi")


def require_all(found: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """found, or an error that names how many needed ids it lacks."""
    lost = needed.select(key).distinct().join(found.select(key), key, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} ids of {key} are missing")
    return found


def read_pairs_tsv(spark: SparkSession, path: str) -> DataFrame:
    """split (from the file's name), left_id, right_id, label; exactly three columns, or an error."""
    raw = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z]+)", 1).alias("split"), F.split("value", "\t", -1).alias("x"), "value").where("value <> ''")
    ok = F.when(F.size("x") == 3, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("three columns expected: "), F.col("value"))))
    return raw.where(ok).select("split", F.get("x", F.lit(0)).alias("left_id"), F.get("x", F.lit(1)).alias("right_id"), F.get("x", F.lit(2)).cast("int").alias("label"))


def read_pairs_csv(spark: SparkSession, path: str, required=("split", "left_id", "right_id", "label")) -> DataFrame:
    """CSV with a header; required columns are checked, splits lower-cased, ids strings."""
    df = spark.read.option("header", True).csv(path)
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    return df.withColumns({"split": F.lower("split"), "left_id": F.col("left_id").cast("string"), "right_id": F.col("right_id").cast("string"), "label": F.col("label").cast("int")})


#: Sections of one table up to which their places are sent to every task.
BROADCAST_SECTIONS = 100_000


def read_copy_section(lines: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Rows of the COPY sections of one table in database dumps, from lines (file, number, value).

    Only the lines where sections start and end are ordered; other lines are compared with those places.
    """
    start, end = F.startswith("value", F.lit(f"COPY {table} ")), F.col("value") == "\\."
    marks = lines.where(start | end).select("file", "number", start.alias("opens"))
    following = F.min(F.when(~F.col("opens"), F.col("number"))).over(Window.partitionBy("file").orderBy("number").rowsBetween(1, Window.unboundedFollowing))
    ranges = marks.withColumn("hi", following).where("opens").select("file", F.col("number").alias("lo"), "hi")
    few = ranges.limit(BROADCAST_SECTIONS + 1).count() <= BROADCAST_SECTIONS
    inside = lines.join(F.broadcast(ranges) if few else ranges, "file").where((F.col("number") > F.col("lo")) & (F.col("hi").isNull() | (F.col("number") < F.col("hi"))))
    parts = inside.withColumn("_x", F.split("value", "\t", -1))
    return parts.select(*[unescape_copy(F.get("_x", F.lit(i))).alias(c) for i, c in enumerate(columns)])


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lists in any files below path, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", "true").json(path).withColumn("source_file", F.col("_metadata.file_name"))


def first_store(stores: list[DataFrame], key: str = "code_id") -> DataFrame:
    """Rows of the first store that has an id."""
    out = None
    for i, s in enumerate(stores):
        s = s.withColumn("_p", F.lit(i))
        out = s if out is None else out.unionByName(s)
    best = out.groupBy(key).agg(F.min("_p").alias("_p"))
    return out.join(best, [key, "_p"]).drop("_p")


def find_file(spark: SparkSession, root: str, *names: str) -> str:
    """The file of the first of these names that stands below root; of several the shallowest, then the first by path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    found, todo = [], [(0, top)]
    while todo:
        depth, folder = todo.pop()
        for status in fs.listStatus(folder):
            path = status.getPath()
            if status.isDirectory():
                todo.append((depth + 1, path))
            elif path.getName() in names:
                found.append((names.index(path.getName()), depth, path.toString()))
    if not found:
        raise FileNotFoundError(f"none of {names} below {root}")
    return min(found)[2]


# Spellings of clone types.
CLONE_TYPES = {f"{p}{i}": f"type_{i}" for i in (1, 2, 3, 4) for p in ("", "type", "t", "type_")}


def clone_type_name(raw):
    """Canonical name of a clone type; an unknown one is an error."""
    key = F.replace(F.replace(F.lower(F.trim(raw)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit(""))
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in CLONE_TYPES.items() for x in kv]), key)
    return F.coalesce(name, F.raise_error(F.concat(F.lit("unknown clone type "), raw)))


def read_clone_dataset(spark: SparkSession, root: str, type_labels: str | None = None) -> dict[str, DataFrame]:
    """codes (code_id, code) and pairs (split, left_id, right_id, label[, clone_type]) of a dataset folder.

    data.jsonl has idx and func; train.txt is required, valid.txt and test.txt are read if they are there. Type labels are
    tab-separated or JSON lines and fit pairs in either direction; a pair without one has none.
    """
    codes = spark.read.schema("idx long, func string").json(find_file(spark, root, "data.jsonl")).select(F.col("idx").cast("string").alias("code_id"), F.col("func").alias("code"))
    find_file(spark, root, "train.txt")
    pairs = None
    for name in ("train.txt", "valid.txt", "test.txt"):
        try:
            part = read_pairs_tsv(spark, find_file(spark, root, name))
        except FileNotFoundError:
            continue
        pairs = part if pairs is None else pairs.unionByName(part)
    if type_labels:
        if type_labels.lower().endswith(".jsonl"):
            t = spark.read.schema("left string, right string, type string").json(type_labels)
        else:
            t = spark.read.schema("left string, right string, type string").option("sep", "\t").csv(type_labels)
        a, b = F.col("left").cast("long"), F.col("right").cast("long")
        t = t.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"), clone_type_name(F.col("type")).alias("clone_type")).dropDuplicates(["_a", "_b"])
        x, y = F.col("left_id").cast("long"), F.col("right_id").cast("long")
        pairs = pairs.withColumns({"_a": F.least(x, y), "_b": F.greatest(x, y)}).join(t, ["_a", "_b"], "left").drop("_a", "_b")
    return {"codes": codes, "pairs": pairs}


def read_feature_shards(spark: SparkSession, root: str, needed: DataFrame | None = None, key: str = "code_id") -> DataFrame:
    """Rows of the Parquet shards that manifest.json lists ({"format": ..., "shards": [names]}); only the needed ids."""
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{root}/manifest.json").collect()))
    if manifest.get("format") != "spectral_feature_shards_v1":
        raise ValueError(f"unknown format {manifest.get('format')!r}")
    df = spark.read.parquet(*[f"{root}/{name}" for name in manifest["shards"]])
    return df if needed is None else require_all(df.join(needed.select(key).distinct(), key, "left_semi"), needed, key)


def cache_audit(targets: DataFrame, index: DataFrame) -> DataFrame:
    """By language: target codes, those that the index (source_id, source_sha256) has, and those that remain. Hashes must
    agree unless one is empty."""
    from ..operators.relational import cache_hits

    h = cache_hits(targets.select("source_id", "language", F.col("source_sha256").alias("h")), index.select("source_id", F.col("source_sha256").alias("h")), "source_id", "h")
    return h.groupBy("language").agg(F.count(F.lit(1)).alias("targets"), F.count_if("reusable").alias("matching"), F.count_if(~F.col("reusable")).alias("remaining"))


class CleanBundle:
    """A bundle of codes, pairs and graph records: JSON lines and CSV in a folder, gzipped or not."""

    def __init__(self, spark: SparkSession, root: str, default_language: str | None = None):
        from ..functions.text import language

        self.spark, self.root = spark, root
        codes = spark.read.json(find_file(spark, root, "codes.jsonl.gz", "codes.jsonl"))
        has = lambda c: F.col(c).cast("string") if c in codes.columns else F.lit(None).cast("string")
        raw = F.coalesce(has("language"), has("lang"), F.lit(default_language))
        known = F.when(raw.isNull(), F.raise_error(F.concat(F.lit("no language for code "), has("code_id")))).otherwise(F.coalesce(language(raw, strict=False), F.lower(raw)))
        self.codes = codes.select(F.coalesce(has("code_id"), has("id"), has("idx")).alias("code_id"), F.coalesce(has("code"), has("source"), F.lit("")).alias("code"), known.alias("language"), has("problem_id").alias("problem_id"), has("source_code_id").alias("source_code_id"), has("source_sha256").alias("source_sha256"))

    def pairs(self, split: str, left: str | None = None, right: str | None = None) -> DataFrame:
        """Pairs of a split with language and problem of both ends, of given languages; a missing end is an error."""
        from ..operators.relational import attach

        p = read_pairs_csv(self.spark, find_file(self.spark, self.root, "pairs.csv.gz", "pairs.csv")).where(F.col("split") == split.strip().lower())
        p = attach(attach(p, self.codes, "language"), self.codes, "problem_id")
        for side, want in (("left", left), ("right", right)):
            if want:
                p = p.where(F.col(f"{side}_language") == want)
        return p

    def graphs(self, needed: DataFrame | None = None, key: str = "code_id") -> DataFrame:
        """Graph records (code_id, graphs) of the needed codes."""
        g = self.spark.read.json(find_file(self.spark, self.root, "graph_spectra.jsonl.gz", "graph_spectra.jsonl"))
        g = g.withColumn("code_id", F.col("code_id").cast("string"))
        return g if needed is None else g.join(needed.select(key).distinct(), key, "left_semi")
