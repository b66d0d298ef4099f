"""Writers: codes, pairs, graphs, shards, score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_codes(codes: DataFrame, path: str) -> None:
    """Gzipped JSON lines in id order, with line and character counts."""
    from ..functions.text import line_count

    c = codes.withColumns({"line_count": line_count(F.col("code")), "char_count": F.char_length("code")})
    c.orderBy("code_id").write.mode("overwrite").json(path, compression="gzip")


def named_labels(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("label_name", F.when(F.col("label") == 1, "clone").otherwise("non_clone"))


def align_metadata(pairs: DataFrame, metadata: DataFrame, keys=("split", "left_id", "right_id")) -> DataFrame:
    """pairs with provenance columns; every pair needs exactly one row of it, or an error."""
    k = list(keys)
    extra = metadata.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in metadata.columns if c not in k])
    j = pairs.join(extra, k, "full_outer").withColumn("_ok", F.when((F.col("_n") == 1) & F.col("label").isNotNull(), True).otherwise(F.raise_error(F.lit("metadata rows and pairs do not align"))))
    return j.where("_ok").drop("_n", "_ok")


def write_pairs(pairs: DataFrame, path: str, metadata: DataFrame | None = None) -> None:
    """CSV with core columns first, provenance in name order, nested values as JSON."""
    p = named_labels(pairs if metadata is None else align_metadata(pairs, metadata))
    core = ["split", "left_id", "right_id", "label", "label_name"]
    rest = sorted(c for c in p.columns if c not in core)
    kinds = dict(p.dtypes)
    nested = lambda c: F.to_json(F.col(c)) if kinds[c].startswith(("struct", "map", "array")) else F.col(c)
    p.select(*core, *[nested(c).alias(c) for c in rest]).write.mode("overwrite").option("header", True).csv(path, compression="gzip")


def write_graph_spectra(graphs: DataFrame, spectra: DataFrame, path: str, precision: int = 8, order: str = "position", pairs: DataFrame | None = None) -> None:
    """Graphs joined with their rounded spectra, one row for each code and layer: of several the first in `order`.

    With `pairs` an end without a graph is an error.
    """
    from ..operators.relational import keep_one

    keys = ["code_id", "layer"]
    one = keep_one(spectra.select(*keys, order, "status", "eigenvalues"), keys, [F.col(order)]).drop(order)
    mine = keep_one(graphs, keys, [F.col(order)]) if order in graphs.columns else graphs.dropDuplicates(keys)
    g = mine.join(one, keys).withColumn("eigenvalues", F.transform("eigenvalues", lambda x: F.round(x, precision))).withColumnRenamed("status", "spectral_status")
    if pairs is not None:
        ends = pairs.select(F.explode(F.array("left_id", "right_id")).alias("code_id")).distinct()
        lost = ends.join(g.select("code_id"), "code_id", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"no graph for {lost[0].code_id}")
    g.write.mode("overwrite").parquet(path)


def write_shards(df: DataFrame, path: str, rows: int) -> DataFrame:
    """Parquet files of at most `rows` rows; the manifest (shard, rows), which is written beside them."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    manifest = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("shard")).agg(F.count(F.lit(1)).alias("rows")).orderBy("shard")
    manifest.coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "-manifest")
    return spark.read.schema("shard string, rows long").json(path.rstrip("/") + "-manifest")


def append_scores(scores: DataFrame, path: str) -> None:
    """Pair scores as CSV with headers, in folders by graph type, K and metric; a missing K is "full"."""
    s = scores.withColumn("k", F.coalesce(F.col("k").cast("string"), F.lit("full")))
    s.write.mode("append").option("header", True).partitionBy("graph_type", "k", "metric").csv(path)


def write_endpoints(pairs: DataFrame, path: str) -> None:
    """The table of pair ends: a row for each end of each pair, with what the pair says."""
    rest = [c for c in pairs.columns if c not in ("left_id", "right_id")]
    ends = pairs.select(F.explode(F.create_map(F.lit("left"), "left_id", F.lit("right"), "right_id")).alias("side", "code_id"), *rest)
    ends.write.mode("overwrite").option("compression", "zstd").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write df beside the table at path, then put it in its place: readers see the old or the new one."""
    import uuid

    spark = df.sparkSession
    fresh, old = (f"{path.rstrip('/')}.{tag}-{uuid.uuid4().hex}" for tag in ("new", "old"))
    df.write.parquet(fresh)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(at(path))
    if there and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(at(fresh), at(path)):
        if there:
            fs.rename(at(old), at(path))
        raise OSError(f"{fresh} cannot be moved to {path}")
    if there:
        fs.delete(at(old), True)


#: Files that a clean bundle must have.
BUNDLE_FILES = ("codes.jsonl.gz", "pairs.csv.gz", "graph_spectra.jsonl.gz", "metadata.json")


def zip_bundle(root: str, target: str, required=BUNDLE_FILES) -> str:
    """A ZIP archive of the files of a local bundle folder, all of which must be there and not empty."""
    import os
    import zipfile

    lost = [n for n in required if not os.path.isfile(os.path.join(root, n)) or not os.path.getsize(os.path.join(root, n))]
    if lost:
        raise FileNotFoundError(f"missing or empty: {', '.join(lost)}")
    with zipfile.ZipFile(target + ".tmp", "w", zipfile.ZIP_STORED) as z:
        for n in required:
            z.write(os.path.join(root, n), n)
    os.replace(target + ".tmp", target)
    return target


def latex_table(rows: DataFrame, method: str, dataset: str, values: list[str], order: list[str], datasets: list[str]) -> str:
    """Lines of a paper's table: methods in the given order, of each dataset its values with four digits, -- where there is none.

    rows has one row for each method and dataset, a few in all.
    """
    cells = {(r[method], r[dataset]): r for r in rows.select(method, dataset, *values).collect()}
    text = lambda m, d, v: "--" if (m, d) not in cells or cells[m, d][v] is None else f"{cells[m, d][v]:.4f}"
    known = [m for m in order if any((m, d) in cells for d in datasets)]
    lines = ["% Method & " + " & ".join(f"{d} " + " ".join(values) for d in datasets)]
    lines += [" & ".join([m, *(text(m, d, v) for d in datasets for v in values)]) + r" \\" for m in known]
    return "\n".join(lines) + "\n"


def write_subset(programs: DataFrame, ids: DataFrame, path: str, key: str = "program_id") -> None:
    programs.join(ids.select(key).distinct(), key, "left_semi").write.mode("overwrite").option("compression", "zstd").parquet(path)
