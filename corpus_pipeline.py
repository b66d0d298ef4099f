"""The corpus pipeline: quality, near duplicates, contamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. Rows that repeat (after mixing) stay documents of their own.
"""

from __future__ import annotations

from pairwright.llm import decontaminate, minhash, mixing, quality_knn, token_output
from pairwright.llm.common import fresh_path, written
from pairwright.llm.queries import tokenizer_path


def quality(spark, docs, sf_dir):
    """Documents that nearest-neighbour voting accepts."""
    return quality_knn.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates, the one with the smallest id."""
    return minhash.representatives(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixing.copies(docs)


def tokens(spark, docs, sf_dir):
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.read_tokens(token_output.write_tokens(docs, fresh_path(spark, "tokens"), tokenizer_path()))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token output", tokens),
]
#: Signatures, voting and token files are not expressible in SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole documents table; every stage's result is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
