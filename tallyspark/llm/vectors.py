"""Vectors of a table as NumPy matrices: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

#: Vectors that a Python worker handles at once.
BLOCK = 4096
#: Rows of a side that may be sent to all tasks, and the parts that a larger one's hot keys are dealt over.
FEW, SALTS = 1_000_000, 64


class Extent(NamedTuple):
    """Rows, the longest vector's length, and the largest absolute entry."""

    rows: int
    width: int
    largest: float


def doubles(column: str = "embedding") -> Column:
    return F.col(column).cast("array<double>")


def finite(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector isn't null and holds neither nulls nor NaN nor infinities. NaN is the greatest value of all, so one comparison finds it."""
    return vectors.where(F.col(column).isNotNull() & F.forall(doubles(column), lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))


def extent(vectors: DataFrame, column: str = "embedding") -> Extent:
    row = vectors.agg(F.count("*"), F.max(F.size(column)), F.max(F.array_max(F.transform(doubles(column), F.abs)))).first()
    return Extent(row[0], row[1] or 0, row[2] or 0.0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows by `width` doubles; a shorter vector goes on with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), C.ragged(np.zeros(len(lengths), np.int64), lengths)] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_side(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """`rows` with the columns of `side`, which has one row a key; null meets null. A side of at most `FEW` rows is sent out; a larger one is repeated for
    each of `SALTS` parts, so that no key's rows come to one task."""
    side = side.withColumnRenamed(key, "__side_key")
    same = F.col(key).eqNullSafe(F.col("__side_key"))
    if side.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(side), same, "left").drop("__side_key")
    side = side.withColumn("__side_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(side, same & (F.col("__salt") == F.col("__side_salt")), "left").drop("__side_key", "__side_salt", "__salt")
