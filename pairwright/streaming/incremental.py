"""Extension: incremental spectra. A stream of graph files is upserted; what is stored already with the same digest and
enough values is not computed again.

A batch writes a folder of its own (store/batch=<number>) and overwrites it if it is run again, so nothing is stored twice. Of
a key the row of the latest batch counts. Where the store is large, `changed` keeps the state by key instead, and a batch
touches that of its own keys alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import cache_hits


def pending(batch: DataFrame, stored: DataFrame, key: str = "code_id", digest: str = "digest", least: int = 0) -> DataFrame:
    """Rows of batch whose stored result is missing, of another digest, or too short."""
    enough = stored.where((F.col("status") != "ok_sparse_topk") | (F.size("eigenvalues") >= least))
    return cache_hits(batch, enough, key, digest).where("not reusable").drop("reusable")


def read_store(spark: SparkSession, store: str, before: int | None = None, key: str = "code_id") -> DataFrame | None:
    """The latest row of every key, of batches before one; None if there is no batch yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.option("basePath", store).parquet(store)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    names = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("_x")).select(key, "_x.*")


def upsert(batch: DataFrame, number: int, store: str, compute: Callable[[DataFrame], DataFrame], least: int = 0, key: str = "code_id") -> None:
    """Compute what is pending of a batch and write it as the batch's folder. A key that stands in it twice is taken once."""
    stored = read_store(batch.sparkSession, store, number, key)
    todo = batch.dropDuplicates([key]) if stored is None else pending(batch.dropDuplicates([key]), stored, key, least=least)
    compute(todo).write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={number}")


def start(spark: SparkSession, source: str, schema: str, store: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str, least: int = 0):
    """A file stream whose every batch computes what is pending and adds it to the store."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, n: upsert(batch, n, store, compute, least)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What the state keeps of a key, and what a batch gives of it.
STATE = "digest string, result string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changed(stream: DataFrame, compute: Callable[[str | None], str | None], key: str = "code_id", digest: str = "digest", payload: str = "payload") -> DataFrame:
    """key, digest, result, fresh of every key that a batch brings: computed if its digest is new, else from the state.

    The state is kept by key, so a batch reads and writes that of its own keys only, whatever has been stored before. Of rows
    of a key in one batch the one with the largest digest counts. Keys must not be null.
    """

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = None  # plain values: a frame's methods cost more than a row's work
        for part in parts:
            for one, text in zip(part[digest].tolist(), part[payload].tolist(), strict=True):
                one = None if pd.isna(one) else one
                if best is None or (one is not None and (best[0] is None or one >= best[0])):
                    best = (one, None if pd.isna(text) else text)
        mine, text = None if best[0] is None else str(best[0]), best[1]
        held = state.get if state.exists else None
        fresh = held is None or mine is None or held[0] != mine
        result = compute(text) if fresh else held[1]
        if fresh:
            state.update((mine, result))
        yield pd.DataFrame({key: [keys[0]], "digest": [mine], "result": [result], "fresh": [fresh]})

    kind = dict(stream.dtypes)[key]
    grouped = stream.where(F.col(key).isNotNull()).select(key, digest, payload).groupBy(key)
    return grouped.applyInPandasWithState(run, f"{key} {kind}, digest string, result string, fresh boolean", STATE, "append", "NoTimeout")


def run_changed(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], compute: Callable[[str | None], str | None], **columns) -> None:
    """Take the files that are new below source through `changed` and append what it gives to the table at out, a folder a batch.

    The state store is the one that the session names; `ROCKSDB` keeps it on disk, so its size is not bound by memory.
    """
    stream = changed(prepare(spark.readStream.schema(schema).parquet(source)), compute, **columns)
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={n}")
    stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
