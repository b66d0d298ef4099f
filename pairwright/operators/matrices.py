"""Sums over vectors of one length: Gram matrix, totals, effective rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

#: Length of vectors up to which their Gram matrix is solved at once; its size does not depend on the number of vectors.
MOST = 4096


def gram(vectors: DataFrame, column: str) -> DataFrame:
    """i, j, g: sums of x[i] * x[j] over all vectors, and with j = -1 sums of x[i], i = j = -1 their number.

    Each task sums its own vectors and hands on one matrix, whose cells are then added up; nulls are left out, and vectors of
    another length than the first of their task's batch are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            column_ = b.column(0).drop_null()
            if not len(column_):
                continue
            sizes = np.diff(column_.offsets.to_numpy())
            if (sizes != sizes[0]).any() or total is not None and sizes[0] + 1 != len(total):
                raise ValueError("vectors of different lengths")
            x = column_.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
            x = np.column_stack([x, np.ones(len(x))])
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            d = len(total) - 1
            place = np.append(np.arange(d), -1).astype(np.int32)
            i, j = np.meshgrid(place, place, indexing="ij")
            keep = (i.ravel() >= 0) | (j.ravel() < 0)
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel()[keep]) for x in (i, j, total)], ["i", "j", "g"])

    cells = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "i int, j int, g double")
    return cells.groupBy("i", "j").agg(F.sum("g").alias("g"))


def effective_rank(count: int, total: np.ndarray, cells: np.ndarray) -> float:
    """exp of the entropy of the squared singular values of centred rows, from their sums and products alone."""
    mass = np.maximum(np.linalg.eigvalsh(cells - np.outer(total, total) / max(count, 1)), 0)
    if mass.max(initial=0) <= 1e-24:
        return 0.0
    mass = mass / mass.sum()
    return float(np.exp(-(mass * np.log(np.maximum(mass, 1e-30))).sum()))


def spectral_rank(vectors: DataFrame, column: str, most: int = MOST) -> tuple[int, int, float]:
    """Number, length and effective rank of vectors. The matrix of their length is solved on the driver if it has no more than
    `most` rows, and is an error beyond."""
    cells = stored(gram(vectors, column), "gram")
    d = (cells.agg(F.max("i").alias("d")).first().d if not cells.isEmpty() else -1) + 1
    if d > most:
        raise ValueError(f"vectors of length {d}; a matrix of {most} rows at most is solved")
    matrix, total, count = np.zeros((d, d)), np.zeros(d), 0
    for r in cells.collect():
        if r.j >= 0:
            matrix[r.i, r.j] = r.g
        elif r.i >= 0:
            total[r.i] = r.g
        else:
            count = round(r.g)
    return count, d, effective_rank(count, total, matrix) if count else 0.0
