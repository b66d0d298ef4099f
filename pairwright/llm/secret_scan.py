"""Secret scans over an incremental ledger of blobs.

Every version of a text is named by its SHA-256 (a blob). The ledger, a folder that outlives the
job, has a row for each blob, rule and rule version scanned, with the spans found, none included. A
scan takes the blobs of its input that lack a row for some current rule, scans each once with just
those rules, appends what it found, and joins the ledger back to all versions. So copies are scanned
once, texts seen before not at all, and a changed rule alone is scanned again. What a job appends is
committed by Spark as a whole; a job that fails leaves nothing, and the next scans what is missing.

Versions of one blob are gathered by partition before they meet the findings, so a blob with many
copies is a few rows in that join.

Cases: a null text is empty; a null doc_id is kept; rows that repeat each get a row; texts may be of
any length and are scanned whole; ties of start are in the order of the rules; extra columns are
ignored; an empty table gives an empty result and leaves the ledger as it was.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shuffle_parts, unpack, written


class Rule(NamedTuple):
    """A pattern; matches whose group (0: all of it) is shorter than `least` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    #: One of these stands in every text with a match, in either case.
    hints: tuple[str, ...] = ()


#: ASCII letters of the names in either case; no other code point folds to them.
_ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
BASE = (
    Rule("assign", 1, _ASSIGN + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),  # the runs of [0-9a-f]+ that are long enough
)
RULES = (
    *BASE,
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xox",)),
)
LEDGER = "digest binary, kind string, version int, spans array<struct<start:int,end:int>>"


def find(rule: Rule, text: str, low: str) -> list[tuple[int, int]]:
    """Spans of a rule in a text, in code points; low: the text in lower case."""
    if rule.hints and not any(h in low for h in rule.hints):
        return []
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]


def read_ledger(spark, path: str) -> DataFrame:
    """digest, kind, version, spans of all scans; empty if there is no ledger yet."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def _blobs(docs: DataFrame) -> DataFrame:
    """(digest, z): compressed texts, each once from each task."""

    def run(batches):
        c, seen = zstandard.ZstdCompressor(level=1), set()
        for b in batches:
            digests, out = b.column("digest").to_pylist(), []
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    out.append((d, c.compress(b.column("text")[i].as_buffer())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["digest", "z"])

    return docs.mapInArrow(lean(run), "digest binary, z binary")


def update(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks of the blobs of docs (digest, text); the pairs (digest, kind, version) that were scanned."""
    spark = docs.sparkSession
    current = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    known = read_ledger(spark, ledger).join(F.broadcast(current), ["kind", "version"]).select("digest", "kind").distinct()
    seen = known.groupBy("digest").agg(F.collect_list("kind").alias("seen"))
    todo = docs.select("digest").distinct().join(seen, "digest", "left")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    todo = todo.select("digest", F.array_except(kinds, F.coalesce("seen", F.array().cast("array<string>"))).alias("kinds"))
    todo = written(todo.where(F.size("kinds") > 0), "secrets-todo")
    by_kind = {r.kind: r for r in rules}

    def run(batches):
        last = None
        for b in batches:
            out = []
            for d, z, names in zip(b.column("digest").to_pylist(), b.column("z"), b.column("kinds").to_pylist(), strict=True):
                if d == last:
                    continue  # another task's copy
                last = d
                text = unpack(z.as_py()).decode()
                low = text.lower()
                out += [(d, k, by_kind[k].version, [{"start": s, "end": e} for s, e in find(by_kind[k], text, low)]) for k in names]
            if out:
                kinds = (pa.binary(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["digest", "kind", "version", "spans"])

    if not todo.isEmpty():
        new = _blobs(docs.select("digest", "text")).join(todo.hint("merge"), "digest").mapInArrow(lean(run), LEDGER)
        new.write.mode("append").option("compression", "zstd").parquet(ledger)
    return todo.select("digest", F.explode("kinds").alias("kind")).join(F.broadcast(current), "kind")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256 and spans (kind:start:end) of every row, from the updated ledger."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    part = F.spark_partition_id().alias("part")
    versions = docs.select("doc_id", "digest", part).groupBy("digest", "part").agg(F.collect_list(F.struct("doc_id")).alias("ids"))
    versions = written(versions, "secrets-versions")
    update(versions.select("digest").distinct().join(docs, "digest") if False else docs, ledger, rules)

    order = spark.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, version int, rank int")
    found = read_ledger(spark, ledger).where(F.size("spans") > 0).join(F.broadcast(order), ["kind", "version"])
    found = found.dropDuplicates(["digest", "kind"]).select("digest", "rank", "kind", F.inline("spans"))
    one = F.struct("start", "rank", "end", "kind")
    found = written(found.groupBy("digest").agg(F.array_sort(F.collect_set(one)).alias("found")), "secrets-found")

    n = shuffle_parts(spark)
    rows = versions.join(found, "digest", "left").repartition(n, "digest", "part")
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    all_ = F.coalesce("found", F.array().cast(found.schema["found"].dataType))
    base = F.filter(all_, lambda x: x["kind"].isin([r.kind for r in BASE]))
    of_kind = lambda k: F.filter(all_, lambda x: x["kind"] == k)
    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    digest = F.sha2(F.array_join(F.transform(base, named), ","), 256)
    rows = rows.select("ids", *counts, digest.alias("base_sha256"), F.array_join(F.transform(all_, named), ",").alias("spans"))
    return rows.select(F.inline("ids"), *[c for c in rows.columns if c != "ids"])


def empty_digest() -> str:
    return hashlib.sha256(b"").hexdigest()
