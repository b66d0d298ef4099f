"""WARC writing with revisit resolution, and reading back.

Headers (id, digest, length) are shuffled by payload digest; the smallest page_id among equal
payloads of at least `least` bytes is the response, the others become revisit records that
refer to it. Archives (gzip, one member a record) are written with fresh headers by the
executors into the shared folder; a manifest of the files of the tasks that succeeded is the
commit, so files of lost or repeated tasks are never read.

Cases: a null html is an empty payload (always a response); a null page_id counts as larger
than any other and is left out of the record's headers; rows that share the smallest page_id
of a payload are all responses; a null or unprintable url is escaped; extra columns are
ignored; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, fresh_path, lean, shuffle_parts, written

LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(path: str):
    """File system and path in it; the shared folder may be local, HDFS or an object store."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of the rows that revisit another row's payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    page = F.struct(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    heads = pages.where(F.octet_length(payload) >= least).select(page.alias("page"), F.sha2(payload, 256).alias("digest"))
    heads = written(heads, "warc-heads")
    first = heads.groupBy("digest").agg(F.min(F.when(F.col("page.page_id").isNotNull(), F.col("page"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and first is not null").select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    again = attached(heads.select("digest", F.col("page.page_id").alias("page_id")), "digest", first)
    return again.where("page_id is null or page_id > refers_to").select("page_id", "digest", "refers_to", "refers_url").distinct()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _uri(url: str | None) -> str:
    return quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~-._")


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record."""
    uri = _uri(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, least: int = LEAST, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write the archives under path; manifest (file, records) of the committed files."""
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), digest.alias("digest"))
    again = resolve(pages, least).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to", "refers_url")
    # the join deals rows out by id as well, so equal payloads do not meet in one task
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("page_id", "url", "html", "digest", "refers_to", "refers_url").sortWithinPartitions("page_id")

    def run(batches):
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        out, name, n, size = None, None, 0, 0
        for b in batches:
            for r in zip(b.column("page_id").to_pylist(), *(b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("url", "html", "digest")), b.column("refers_to").to_pylist(), b.column("refers_url").to_pylist(), strict=True):
                if out is None:
                    name, n, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(record(r[0], r[1], (r[2] or "").encode(), r[3], r[4], date, r[5])) + z.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "records": pa.array([n], pa.int64())})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "records": pa.array([n], pa.int64())})

    return written(rows.mapInArrow(lean(run), "file string, records long"), "warc-manifest")


def parse(stream):
    """(headers, block) of every record in a stream of WARC bytes."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode()] = v.strip().decode()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n or hashlib.sha256(block).hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
            raise ValueError(f"damaged record {head.get('warc-record-id')}")
        yield head, block


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's archives: RESULT's columns, url and html (null if revisit)."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for file in b.column("file").to_pylist():
                fs, at = open_fs(file)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in parse(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        kind = head["warc-type"]
                        if kind == "response":
                            n = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"payload digest differs in {file}")
                        else:
                            n = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        page, ref = head.get("warc-page-id"), head.get("warc-refers-to-page-id")
                        rows.append((page and int(page), n, digest, kind, ref and int(ref), head["warc-target-uri"], payload.decode() if kind == "response" else None))
                        held += len(block)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = shuffle_parts(manifest.sparkSession)
    return manifest.repartition(n, "file").mapInArrow(lean(run), RESULT + ", url string, html string")


def roundtrip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages as archives, read the archives back: RESULT's columns for every page."""
    manifest = write_archives(pages, fresh_path(pages.sparkSession, "warc"), least)
    return read_archives(manifest).drop("url", "html")
