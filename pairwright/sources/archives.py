"""Archives as Spark data sources: members of ZIP files, blocks of database dumps, misnamed compression.

A source plans from directories alone (a ZIP's central directory, a dump's table of contents): each
member, run of Parquet row groups, table block or byte range becomes a partition, and a task reads
just its bytes. So one large archive is read by as many tasks as it has parts. Writers run in tasks
too; the table of the files they finished is the commit.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .storage import stored

#: Bytes of a stored Parquet member, or of a plain text file, from which several tasks read it.
SPLIT = 64 << 20
#: Bytes that are read and handed on at a time.
CHUNK = 1 << 20
#: Bytes of small parts that one task reads, one after the other, and parts up to which each has a task of its own.
PACK, APART = 4 << 20, 64


@dataclass
class Parts(InputPartition):
    """Parts of archives or texts for one task."""

    parts: list


def together(parts: list[tuple[int, InputPartition]], room: int = PACK, apart: int = APART) -> list[InputPartition]:
    """Parts (bytes, part) in their order, as many to a task as have `room`: beyond a few tasks they grow with bytes, not with parts."""
    room = min(room, sum(size for size, _ in parts) / apart)
    out, held = [], 0
    for size, part in parts:
        if not out or held + size > room or len(parts) <= apart:
            out.append([])
            held = 0
        out[-1].append(part)
        held += size
    return [Parts(x) for x in out]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files that a path names: itself, those a pattern matches, or those below a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out, todo = [], list(fs.globStatus(p) or [])
    while todo:
        status = todo.pop()
        if status.isDirectory():
            todo += list(fs.listStatus(status.getPath()))
        elif not status.getPath().getName().startswith(("_", ".")):
            out.append(status.getPath().toString())
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


class _Slice(io.RawIOBase):
    """Bytes start to stop of a file, as a file."""

    def __init__(self, raw, start: int, size: int):
        self.raw, self.start, self.size, self.at = raw, start, size, 0

    def seekable(self):
        return True

    def readable(self):
        return True

    def tell(self):
        return self.at

    def seek(self, offset, whence=0):
        self.at = (0, self.at, self.size)[whence] + offset
        return self.at

    def read(self, n=-1):
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        self.raw.seek(self.start + self.at)
        out = self.raw.read(max(0, n))
        self.at += len(out)
        return out


@dataclass
class Member(InputPartition):
    """A ZIP member, or some row groups of one."""

    file: str
    name: str
    offset: int
    packed: int
    size: int
    method: int
    groups: tuple[int, int] | None = None

    def open(self, raw):
        """The member's content as a file; only a member that is stored is read in parts."""
        raw.seek(self.offset)
        name, extra = struct.unpack("<26xHH", raw.read(30))
        start = self.offset + 30 + name + extra
        if self.method == zipfile.ZIP_STORED:
            return _Slice(raw, start, self.size)
        if self.method != zipfile.ZIP_DEFLATED:
            raise ValueError(f"{self.name} in {self.file}: compression {self.method} is not known")
        raw.seek(start)
        return io.BytesIO(zlib.decompress(raw.read(self.packed), -15))


def members(file: str, pattern: str) -> list[Member]:
    """Members of a ZIP file whose name matches, from its central directory."""
    fs, path = file_system(file)
    with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
        return [Member(file, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type) for i in z.infolist() if not i.is_dir() and re.search(pattern, i.filename)]


class _ZipReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.pattern, self.kind = json.loads(options["files"]), options["pattern"], options["kind"]
        self.columns, self.split = json.loads(options.get("columns", "null")), int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for m in (m for f in self.files for m in members(f, self.pattern)):
            if self.kind != "parquet" or m.method != zipfile.ZIP_STORED or m.size <= self.split:
                out.append((m.packed, m))
                continue
            fs, path = file_system(m.file)
            with fs.open_input_file(path) as raw:
                n = pq.ParquetFile(m.open(raw)).num_row_groups
            step = max(1, n * self.split // m.size)
            out += [(self.split, Member(**{**m.__dict__, "groups": (a, min(n, a + step))})) for a in range(0, n, step)]
        return together(out)

    def read(self, partition: Parts | None) -> Iterator[pa.RecordBatch]:
        for part in () if partition is None else partition.parts:  # None: there are none
            yield from self._read(part)

    def _read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(partition.file)
        with fs.open_input_file(path) as raw:
            content = partition.open(raw)
            if self.kind == "parquet":
                f = pq.ParquetFile(content)
                groups = None if partition.groups is None else list(range(*partition.groups))
                for b in f.iter_batches(row_groups=groups, columns=self.columns, batch_size=10_000):
                    yield b.select(self.columns) if self.columns else b
            else:
                with np.load(io.BytesIO(content.read()), allow_pickle=False) as a:
                    ids, values = [str(i) for i in a["code_ids"]], a["eigenvalues"].astype("float64")
                if len(ids) != len(values):
                    raise ValueError(f"{partition.name}: {len(ids)} ids, {len(values)} spectra")
                for i in range(0, len(ids), 1000):
                    v = values[i : i + 1000]
                    spectra = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(v)), pa.array(ids[i : i + 1000]), spectra], ["file", "code_id", "eigenvalues"])


class ZipMembers(DataSource):
    """Parquet or NumPy members of ZIP files. Options: files, pattern, kind, columns, split."""

    @classmethod
    def name(cls):
        return "zip_members"

    def reader(self, schema):
        return _ZipReader(dict(self.options))


def read_parquet_zip(spark: SparkSession, path: str, pattern: str, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Parquet members of ZIP archives whose name matches, a task for each member or run of its row groups; only the columns
    asked for are decoded."""
    from pyspark.sql.pandas.types import from_arrow_schema

    files = list_files(spark, path)
    first = next((m for f in files for m in members(f, pattern)), None)
    if first is None:
        raise FileNotFoundError(f"no member of {path} matches {pattern}")
    fs, at = file_system(first.file)
    with fs.open_input_file(at) as raw:
        schema = from_arrow_schema(pq.ParquetFile(first.open(raw)).schema_arrow)
    if columns:
        schema = type(schema)([schema[c] for c in columns])
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").schema(schema).options(files=json.dumps(files), pattern=pattern, kind="parquet", columns=json.dumps(schema.names), split=split).load()


def read_latent_zip(spark: SparkSession, path: str) -> DataFrame:
    """code_id, eigenvalues of the bundles at path, a task for each shard; repeated ids or a count other than the manifest's are
    errors.

    A bundle may stand below a folder in its ZIP: the shallowest manifest.json with shards (.npz) beside or below it counts.
    """
    bundles = {}
    for f in list_files(spark, path):
        names = {m.name: m for m in members(f, "")}
        tops = [n[: -len("manifest.json")] for n in names if n.endswith("manifest.json")]
        tops = [t for t in tops if any(n.startswith(t) and n.endswith(".npz") for n in names)]
        if not tops:
            raise FileNotFoundError(f"{f} has no manifest with shards")
        top = min(tops, key=lambda t: (t.count("/"), len(t), t))
        fs, at = file_system(f)
        with fs.open_input_file(at) as raw:
            bundles[f] = (top, json.loads(names[top + "manifest.json"].open(raw).read())["code_count"])
    spark.dataSource.register(ZipMembers)
    out = None
    for top in {t for t, _ in bundles.values()}:
        files = [f for f, (t, _) in bundles.items() if t == top]
        part = spark.read.format("zip_members").schema("file string, code_id string, eigenvalues array<double>").options(files=json.dumps(files), pattern=f"^{re.escape(top)}.*\\.npz$", kind="npz").load()
        out = part if out is None else out.unionByName(part)
    n = out.groupBy("file", "code_id").agg(F.count(F.lit(1)).alias("n")).groupBy("file").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()  # a row a bundle
    for r in n:
        if r.most > 1:
            raise ValueError(f"a code id stands in {r.file} twice")
        if r.n != bundles[r.file][1]:
            raise ValueError(f"{r.file} has {r.n} codes, its manifest {bundles[r.file][1]}")
    return out.drop("file")


def _write_zips(df: DataFrame, path: str, rows: int, member, last) -> DataFrame:
    """A ZIP a task, with a member for every `rows` rows; file, members, rows of the finished ones (a written table)."""

    def run(batches):
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        file, z, stream, held, pend, total = f"part-{uuid.uuid4().hex}.zip", None, None, 0, [], 0

        def flush():
            t = pa.Table.from_batches(pend)
            while t.num_rows:
                name, data = member(len(z.infolist()), t.slice(0, rows))
                z.writestr(name, data)
                t = t.slice(rows)

        for b in batches:
            if b.num_rows and z is None:
                stream = fs.open_output_stream(f"{root}/{file}", compression=None)
                z = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
            pend, held, total = [*pend, b], held + b.num_rows, total + b.num_rows
            if held >= rows:
                flush()
                pend, held = [], 0
        if z is not None:
            if held:
                flush()
            n = len(z.infolist())
            for name, data in last(total):
                z.writestr(name, data)
            z.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{file}"], "members": pa.array([n], pa.int64()), "rows": pa.array([total], pa.int64())})

    return stored(df.mapInArrow(run, "file string, members long, rows long"), "zips")


def write_parquet_zips(df: DataFrame, path: str, name: str, rows: int) -> DataFrame:
    """df as Parquet members <name>__<number>.parquet of ZIP files below path, a file for each of df's partitions."""

    def member(k, table):
        raw = io.BytesIO()
        pq.write_table(table, raw, row_group_size=max(1, rows // 4))
        return f"{name}__{k:05d}.parquet", raw.getvalue()

    return _write_zips(df, path, rows, member, lambda total: [])


def write_latent_zips(spectra: DataFrame, path: str, rows: int) -> DataFrame:
    """spectra (code_id, eigenvalues of one length) as bundles: NumPy shards and a manifest with their number."""

    def member(k, table):
        raw = io.BytesIO()
        values = np.array(table.column("eigenvalues").to_pylist(), dtype=np.float64)
        np.savez_compressed(raw, code_ids=np.array(table.column("code_id").to_pylist()), eigenvalues=values)
        return f"shards/shard-{k:05d}.npz", raw.getvalue()

    plain = spectra.select(F.col("code_id").cast("string").alias("code_id"), F.col("eigenvalues").cast("array<double>").alias("eigenvalues"))
    return _write_zips(plain, path, rows, member, lambda total: [("manifest.json", json.dumps({"code_count": total}))])


# ---- database dumps in the custom archive format ----

MAGIC, CUSTOM, DATA = b"PGDMP", 1, 1


class _Fields:
    """Numbers and strings of a dump's head and table of contents."""

    def __init__(self, stream):
        self.stream = stream
        if stream.read(5) != MAGIC:
            raise ValueError("not a database dump")
        major, minor, _, self.int_size, self.offset_size, kind = stream.read(6)
        self.version = (major, minor)
        if kind != CUSTOM:
            raise ValueError(f"dump format {kind} is not the custom one")

    def number(self) -> int:
        sign, raw = self.stream.read(1), self.stream.read(self.int_size)
        if len(raw) < self.int_size:
            raise EOFError("the dump ends early")
        n = int.from_bytes(raw, "little")
        return -n if sign[0] else n

    def text(self) -> str | None:
        n = self.number()
        return None if n < 0 else self.stream.read(n).decode("utf-8", "replace")

    def since(self, minor: int) -> bool:
        return self.version >= (1, minor)


@dataclass
class Block(InputPartition):
    """The data of one entry of a dump."""

    file: str
    schema: str
    table: str
    copy: str
    offset: int
    packed: bool
    int_size: int


def dump_entries(file: str) -> list[Block]:
    """Entries with data of a dump, from its table of contents."""
    fs, path = file_system(file)
    with fs.open_input_stream(path) as raw:
        f = _Fields(raw)
        if f.since(15):
            method = raw.read(1)[0]
            if method > 1:
                raise ValueError(f"compression {method} of {file} is not known")
            packed = method == 1
        else:
            packed = f.number() != 0
        for _ in range(7):  # when it was written
            f.number()
        for _ in range(3 if f.since(10) else 1):  # database, versions of server and tool
            f.text()
        out = []
        for _ in range(f.number()):
            f.number(), f.number()  # id, whether it has data
            f.text(), f.text()  # catalog ids
            tag, kind = f.text(), f.text()
            if f.since(11):
                f.number()  # section
            f.text(), f.text()  # definition, removal
            copy, schema = f.text() or "", f.text() or ""
            for _ in range(1 + f.since(14)):  # tablespace, access method
                f.text()
            if f.since(16):
                f.number()  # kind of relation
            f.text(), f.text()  # owner, oids
            while f.text() is not None:  # what it depends on
                pass
            state, offset = raw.read(1)[0], int.from_bytes(raw.read(f.offset_size), "little")
            if kind == "TABLE DATA" and state == 2:
                out.append(Block(file, schema, tag, copy, offset, packed, f.int_size))
        return out


class _DumpReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.schema, self.table = json.loads(options["files"]), options["schema_name"], options["table"]

    def partitions(self):
        out = []
        for f in self.files:
            fs, path = file_system(f)
            entries = sorted(dump_entries(f), key=lambda b: b.offset)
            ends = [b.offset for b in entries[1:]] + [fs.get_file_info(path).size]
            out += [(max(0, end - b.offset), b) for b, end in zip(entries, ends, strict=False) if (b.schema, b.table) == (self.schema, self.table)]
        return together(out)

    def read(self, partition: Parts | None) -> Iterator[pa.RecordBatch]:
        for part in () if partition is None else partition.parts:
            yield from self._read(part)

    def _read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(partition.file)
        with fs.open_input_file(path) as raw:
            raw.seek(partition.offset)

            def number():
                sign = raw.read(1)
                n = int.from_bytes(raw.read(partition.int_size), "little")
                return -n if sign and sign[0] else n

            if raw.read(1)[0] != DATA:
                raise ValueError(f"{partition.table} in {partition.file}: no data block at {partition.offset}")
            number()
            inflate, rest = zlib.decompressobj() if partition.packed else None, b""
            while True:
                n = number()
                data = raw.read(n) if n else b""
                if len(data) < n:
                    raise EOFError(f"{partition.file} ends within {partition.table}")
                plain = data if inflate is None else inflate.decompress(data) if n else inflate.flush()
                *lines, rest = (rest + plain).split(b"\n")
                if not n and rest:
                    lines, rest = [*lines, rest], b""
                lines = [x.decode("utf-8", "replace") for x in lines if x and x != b"\\."]
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines)), pa.array([partition.copy] * len(lines)), pa.array(lines)], ["file", "copy", "value"])
                if not n:
                    return


class DumpBlocks(DataSource):
    """Lines of the data of one table in database dumps. Options: files, schema_name, table."""

    @classmethod
    def name(cls):
        return "dump_blocks"

    def schema(self):
        return "file string, copy string, value string"

    def reader(self, schema):
        return _DumpReader(dict(self.options))


def read_dump(spark: SparkSession, path: str, table: str, columns: list[str], schema: str = "public") -> DataFrame:
    """Rows of a table in custom-format dumps, as strings by column; a task for each entry, which is streamed.

    \\N and a missing last column are null. The columns are found by the entry's COPY statement, or are in order without one.
    """
    from ..functions.text import unescape_copy

    spark.dataSource.register(DumpBlocks)
    lines = spark.read.format("dump_blocks").options(files=json.dumps(list_files(spark, path)), schema_name=schema, table=table).load()
    named = F.split(F.regexp_replace(F.regexp_extract("copy", r"\(([^)]*)\)", 1), r'[\s"]', ""), ",")
    at = lambda c, i: F.when(F.col("copy") == "", F.lit(i)).otherwise(F.array_position(named, c) - 1)
    parts = lines.withColumn("_x", F.split("value", "\t", -1))
    field = lambda c, i: F.get("_x", at(c, i))
    return parts.select(*[F.when(field(c, i) != "\\N", unescape_copy(field(c, i))).alias(c) for i, c in enumerate(columns)])


def write_dumps(df: DataFrame, path: str, table: str, schema: str = "public", compress: bool = True, entry_rows: int = 1000) -> DataFrame:
    """df's columns, as text, in custom-format dumps (version 1.14), a file for each partition with an entry for every
    `entry_rows` rows; file, members, rows of the finished ones."""
    columns = df.columns
    text = lambda c: F.coalesce(F.regexp_replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), "\r", "\\\\r"), F.lit("\\N"))
    lines = df.select(F.concat_ws("\t", *[text(c) for c in columns]).alias("value"))
    number = lambda n: bytes([n < 0]) + abs(n).to_bytes(4, "little")
    string = lambda s: number(-1) if s is None else number(len(s.encode())) + s.encode()
    copy = f"COPY {schema}.{table} ({', '.join(columns)}) FROM stdin;\n"

    def entry(k, offset):
        parts = [number(k), number(1), string("0"), string("0"), string(table), string("TABLE DATA"), number(3), string(""), string(""), string(copy), string(schema), string(""), string(""), string("owner"), string("false"), string(None)]
        return b"".join(parts) + b"\x02" + offset.to_bytes(8, "little")

    def run(batches):
        blocks, total, pend = [], 0, []

        def close():
            body = "".join(f"{x}\n" for x in pend).encode() + b"\\.\n"
            body = zlib.compress(body) if compress else body
            chunks = [body[i : i + 4096] for i in range(0, len(body), 4096)]
            blocks.append(bytes([DATA]) + number(len(blocks) + 1) + b"".join(number(len(c)) + c for c in chunks) + number(0))

        for b in batches:
            for v in b.column("value").to_pylist():
                pend.append(v)
                total += 1
                if len(pend) >= entry_rows:
                    close()
                    pend = []
        if pend:
            close()
        if not blocks:
            return
        head = MAGIC + bytes([1, 14, 0, 4, 8, CUSTOM]) + number(-1 if compress else 0) + b"".join(map(number, (0, 0, 0, 1, 0, 120, 0))) + b"".join(map(string, ("db", "14", "14"))) + number(len(blocks))
        at, toc = len(head) + sum(len(entry(k + 1, 0)) for k in range(len(blocks))), b""
        for k, x in enumerate(blocks):
            toc, at = toc + entry(k + 1, at), at + len(x)
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        file = f"part-{uuid.uuid4().hex}.dump"
        with fs.open_output_stream(f"{root}/{file}", compression=None) as out:
            for x in (head, toc, *blocks):
                out.write(x)
        yield pa.RecordBatch.from_pydict({"file": [f"{path}/{file}"], "members": pa.array([len(blocks)], pa.int64()), "rows": pa.array([total], pa.int64())})

    return stored(lines.mapInArrow(run, "file string, members long, rows long"), "dumps")


# ---- text whose compression its name does not tell ----


@dataclass
class Text(InputPartition):
    file: str
    start: int
    stop: int
    packed: bool


class _TextReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.split = json.loads(options["files"]), int(options["split"])

    def partitions(self):
        out = []
        for file in self.files:
            fs, path = file_system(file)
            size = fs.get_file_info(path).size
            with fs.open_input_stream(path, compression=None) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
            out += [(size, Text(file, 0, size, True))] if packed else [(self.split, Text(file, a, min(size, a + self.split), False)) for a in range(0, size, self.split)]
        return together(out)

    def read(self, partition: Parts | None) -> Iterator[pa.RecordBatch]:
        for part in () if partition is None else partition.parts:
            yield from self._read(part)

    def _read(self, partition: Text) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(partition.file)
        with fs.open_input_file(path) as raw:
            for lines in _gzip_lines(raw) if partition.packed else _range_lines(raw, partition.start, partition.stop):
                lines = [x.decode("utf-8", "replace") for x in lines if x]
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines)), pa.array(lines)], ["file", "value"])


def _gzip_lines(raw) -> Iterator[list[bytes]]:
    """Lines of a gzip stream of any number of members, a chunk's at a time."""
    inflate, rest, data, inside = zlib.decompressobj(31), b"", b"", False
    while data or (data := raw.read(CHUNK)):
        plain, inside = inflate.decompress(data, 4 * CHUNK), True
        data = inflate.unconsumed_tail
        if inflate.eof:
            data, inside = inflate.unused_data.lstrip(b"\0"), False  # another member, or padding
            inflate = zlib.decompressobj(31)
        *lines, rest = (rest + plain).split(b"\n")
        yield lines
    if inside:
        rest += inflate.flush()
        if not inflate.eof:
            raise EOFError("a gzip stream ends early")
    yield rest.split(b"\n")


def _range_lines(raw, start: int, stop: int) -> Iterator[list[bytes]]:
    """Lines that begin in a range of bytes."""
    at = max(0, start - 1)
    raw.seek(at)
    rest, skip = b"", start > 0
    # no more than the range first; what its last line has beyond is looked for in steps that grow
    step = min(CHUNK, stop - at)
    while data := raw.read(step):
        step = min(CHUNK, max(1 << 12, 2 * step if raw.tell() > stop else stop - raw.tell()))
        *lines, tail = (rest + data).split(b"\n")
        out = []
        for x in lines:
            if skip:
                skip = False
            elif at < stop:
                out.append(x)
            at += len(x) + 1
        yield out
        rest = tail
        if at >= stop and not skip:
            return
    if rest and not skip and at < stop:
        yield [rest]


class MisnamedText(DataSource):
    """Lines of files, gzip or not by their first bytes. Options: files, split."""

    @classmethod
    def name(cls):
        return "misnamed_text"

    def schema(self):
        return "file string, value string"

    def reader(self, schema):
        return _TextReader(dict(self.options))


def read_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, value of text lines that are not empty; gzip is told by the first bytes, not by the name. Plain files are read in
    ranges, gzip is streamed; bytes that are not UTF-8 are replaced."""
    spark.dataSource.register(MisnamedText)
    return spark.read.format("misnamed_text").options(files=json.dumps(list_files(spark, path)), split=split).load()
