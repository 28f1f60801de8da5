"""Compression of vectors to short codes: product quantisation by k-means over integer components.

Vectors are cut into equal consecutive parts, each part is replaced by the number of its nearest codebook entry. Components are floored integers, so every sum,
distance and codebook is exact and doesn't depend on how the table is partitioned.

The vectors are staged once, as columnar blocks: a block is a matrix with a row for each dimension. A round of k-means is one `treeAggregate` over the RDD of
blocks: within a block, distances to all entries of a part accumulate dimension by dimension, `np.add.at` adds parts to the sums and counts of their nearest
entries, and these two tensors (parts x entries x dimensions of a part, whatever the table's size) merge through a tree of tasks. The driver divides and starts the
next round. Codes come from a last pass over the rows.

Nulls: rows whose vector is null or holds nulls, NaN or infinities are dropped; a null id is the largest id, a null label is a label of its own. Vectors of unequal
length go on with zeros up to the longest one's length, rounded up to whole parts; so an empty vector is one of zeros. Ties: the entry with the lower index; among
equal ids, the lesser vector comes first. Repeated rows count each time. With fewer vectors than entries there are as many entries as vectors. An empty table gives
an empty result. Components too large for 64-bit distances are handled by Python's integers; an error that isn't a long is the largest long. There is no text. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C, vectors as V

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Levels of the tree in which sums and counts merge.
DEPTH = 2
LARGEST = 2**63 - 1


class Codebooks(NamedTuple):
    """parts x entries x dimensions of a part, and the scale that components were multiplied by."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def integers(doubles: np.ndarray, exact: bool) -> np.ndarray:
    """Floored components; as Python's integers if 64 bits are too few for what is computed from them."""
    floored = np.floor(doubles)
    return floored.astype(np.int64) if exact else np.array([int(c) for c in floored.reshape(-1)], object).reshape(floored.shape)


def nearest(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest entry of each part. `block` has a row a dimension, results have a row a part."""
    parts, count, dims = entries.shape
    codes, errors = np.zeros((parts, block.shape[1]), np.int64), np.zeros((parts, block.shape[1]), block.dtype)
    for p in range(parts):
        distance = np.zeros((count, block.shape[1]), block.dtype)
        for d in range(dims):
            gap = block[p * dims + d] - entries[p, :, d, None]
            distance += gap * gap
        codes[p] = distance.argmin(axis=0)
        errors[p] = distance.min(axis=0)
    return codes, errors


def tallied(sums: np.ndarray, counts: np.ndarray, block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add a block's parts to the sums and counts of their nearest entries."""
    codes, _ = nearest(block, entries)
    dims = entries.shape[2]
    for p, found in enumerate(codes):
        np.add.at(sums[p], found, block[p * dims : (p + 1) * dims].T)
        np.add.at(counts[p], found, 1)
    return sums, counts


def columnar(vectors: DataFrame, width: int, scale: int, exact: bool) -> DataFrame:
    """Vectors as staged blocks: the bytes of a matrix of 64-bit integers, or of whole doubles if `exact` is false, with a row for each of `width` dimensions."""
    kind = np.int64 if exact else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.blocks(batches):
            cells = np.ascontiguousarray(np.floor(V.matrix(batch.column(0), width) * scale).T.astype(kind))
            yield pa.RecordBatch.from_pydict({"cells": pa.array([cells.tobytes()], pa.binary())})

    return C.staged(vectors.mapInArrow(pack, "cells binary"), "vector-blocks")


def trained(staged: DataFrame, entries: np.ndarray, rounds: int, exact: bool) -> np.ndarray:
    """`entries` after so many rounds of k-means over the staged blocks."""
    width = entries.shape[0] * entries.shape[2]

    def unpack(row) -> np.ndarray:
        cells = np.frombuffer(row[0], np.int64 if exact else np.float64).reshape(width, -1)
        return cells if exact else integers(cells, exact)

    cells = staged.rdd.map(unpack)
    for _ in range(rounds):
        now = entries
        zero = (np.zeros(now.shape, now.dtype), np.zeros(now.shape[:2], np.int64))
        sums, counts = cells.treeAggregate(zero, lambda acc, block: tallied(*acc, block, now), lambda a, b: (a[0] + b[0], a[1] + b[1]), DEPTH)
        used = counts > 0
        entries = np.where(used[..., None], sums // np.where(used, counts, 1)[..., None], now)
    return entries


def fit(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of all `vectors`, which `vectors.finite` lets pass; None without any. They start as the parts of the vectors with the smallest ids."""
    rows, width, largest = V.extent(vectors, column)
    if not rows:
        return None
    dims = max(1, -(-width // parts))
    most = int(largest * scale) + 1
    exact = max(4 * most * most * dims, most * rows) < 2**62
    values = vectors.select(V.doubles(column).alias("vector"))
    first = vectors.select(F.col(id_col).alias("id"), V.doubles(column).alias("vector")).orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = integers(V.matrix(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), parts * dims) * scale, exact)
    start = np.ascontiguousarray(start.reshape(len(first), parts, dims).transpose(1, 0, 2))
    return Codebooks(trained(columnar(values, parts * dims, scale, exact), start, rounds, exact), scale)


def encoded(vectors: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id", "label"), column: str = "embedding") -> DataFrame:
    """`keep`, the code (two hexadecimal digits a part) and the squared error of each vector."""
    parts, _, dims = books.entries.shape
    exact = books.entries.dtype != object
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, scale = held.value
        for batch in V.blocks(batches):
            block = integers(V.matrix(batch.column(batch.num_columns - 1), parts * dims) * scale, exact).T
            codes, errors = nearest(np.ascontiguousarray(block), entries)
            digits = np.frombuffer(codes.T.astype(np.uint8).tobytes().hex().encode(), np.uint8)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * 2 * parts
            code = pa.Array.from_buffers(pa.utf8(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(digits)])
            error = np.array([min(int(e), LARGEST) for e in errors.sum(axis=0)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], code, pa.array(error)], [*batch.schema.names[:-1], "code", "error"])

    rows = vectors.select(*keep, V.doubles(column).alias("vector"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(encode, f"{kinds}, code string, error long")


def decoded(coded: DataFrame, books: Codebooks, column: str = "code") -> DataFrame:
    """`coded` with `vector`, the codebook entries that a code names, in the components' first scale."""
    parts = books.entries.shape[0]
    table = F.array(*(F.array(*(F.array(*(F.lit(float(c) / books.scale) for c in entry)) for entry in part)) for part in books.entries.tolist()))
    digits = [F.conv(F.substring(column, 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    return coded.withColumn("vector", F.concat(*(table[p][digits[p]] for p in range(parts))))


def compressed(vectors: DataFrame, **options) -> tuple[Codebooks | None, DataFrame]:
    """The codebooks, and vec_id, label, code, error and label_error of every finite vector."""
    kept = V.finite(vectors)
    books = fit(kept, **options)
    if books is None:
        return None, kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
    rows = C.staged(encoded(kept, books), "codes")
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    return books, V.with_side(rows, C.staged(rows.groupBy("label").agg(whole.alias("label_error")), "label-errors"), "label")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, rows = compressed(C.table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"), "label")
