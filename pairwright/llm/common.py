"""Shared pieces of the corpus operators: shared folder, written tables, text passes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see (spark.checkpoint.dir).

    Only where the setting is absent and Spark runs in one process, a temporary folder is set; on a cluster
    executors would write to disks of their own, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the number of rows that `attached` gathers at most.
GATHER = 12


def attached(rows: DataFrame, key: str, info: DataFrame) -> DataFrame:
    """rows joined with info, which has at most a row for each key.

    Neighbouring rows of one key are gathered first, so of a key that holds a third of all rows the join sees one in some
    thousands; what it gives is dealt out again before the rows are unpacked. Rows without info are left out.
    """
    rest = [c for c in rows.columns if c != key]
    chunk = F.shiftright(F.monotonically_increasing_id(), GATHER).alias("_chunk")
    packed = rows.select(key, chunk, F.struct(*rest).alias("_row")).groupBy(key, "_chunk").agg(F.collect_list("_row").alias("_rows"))
    met = packed.join(info, key).repartition(shuffle_parts(rows.sparkSession), key, "_chunk")
    return met.select(key, *[c for c in info.columns if c != key], F.inline("_rows"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, rid, id, text): did and rid together name a row by its id and whole text.

    Rows that repeat with the same id and text share the key and so share every verdict;
    a null id is kept in `id` and counts as 0 in `did`; a null text is empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("did"),
        F.xxhash64(F.col(id_col).cast("long"), text).alias("rid"),
        F.col(id_col).cast("long").alias("id"),
        text.alias("text"),
    )


def release() -> None:
    """Give memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def lean(run):
    """run, for mapInArrow, with `release` at the end of a task: Python workers stay, and their memory with them."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column without nulls, and len+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - (off[0] if len(off) else 0)


def packed(docs: DataFrame) -> DataFrame:
    """(did, rid, id, z): texts compressed before they are shuffled."""

    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            raw, off = text_bytes(b.column("text"))
            view = memoryview(raw)
            z = [c.compress(view[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), b.column("id"), pa.array(z, pa.binary())], ["did", "rid", "id", "z"])

    docs = docs if "id" in docs.columns else docs.withColumn("id", F.lit(None).cast("long"))
    return docs.select("did", "rid", "id", "text").mapInArrow(lean(run), "did long, rid long, id long, z binary")


def unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def random_table(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = random_table(256, 7)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """First n powers of the hash base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1 << 16), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS[:n]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the first word of each text (len(texts)+1)."""
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = end - start
    width = int(lengths.max())
    if width > 4096:  # few very long words: one at a time
        out = np.empty(len(start), np.uint64)
        short = lengths <= 4096
        out[short] = word_hashes(raw, start[short], end[short])
        for i in np.flatnonzero(~short):
            w = _BYTE[raw[start[i] : end[i]]] * powers(int(lengths[i]))
            out[i] = mix64(np.array([w.sum(dtype=np.uint64) + np.uint64(lengths[i])]))[0]
        return out
    total = int(lengths.sum())
    shift = np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
    at = np.arange(total) + shift
    pos = at - np.repeat(start, lengths)
    value = _BYTE[raw[at]] * powers(width)[pos]
    sums = np.add.reduceat(value, np.cumsum(lengths) - lengths)
    return mix64(sums + lengths.astype(np.uint64))


#: Bytes of text that a Python worker turns into arrays at a time; the arrays are some hundred times as large.
STEP = 1 << 19


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
