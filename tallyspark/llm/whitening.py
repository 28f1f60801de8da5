"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become integers, and each distinct vector counts once. Sums are exact. Tasks add up the scatter of centred vectors, dims x dims numbers each, which merge
through a tree; the driver diagonalises the covariance by cyclic Jacobi rotations, which find small eigenvalues to high relative accuracy, sorts, and
broadcasts the whitening matrix. A last pass over the rows projects them; the covariance of what it gives is measured over the distinct vectors again.

An entry lies near `OFFSET`, far from zero against its spread. So vectors are centred in two steps: the whole part of the mean is taken off as an integer, then the
fraction that is left; nothing cancels.

Nulls: rows whose vector is null or holds nulls, NaN or infinities are dropped; ids are passed on, null or not. Vectors of unequal length go on with zeros. Entries
beyond 2**52 / 64 count as that. Ties: equal eigenvalues keep the order of their dimensions; repeated vectors count once in the fit and have rows each. Components
without variance don't exist: fewer than two distinct vectors, or an empty table, give an empty result. A deviation that isn't a long is the largest long. There is
no text. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C, vectors as V

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Levels of the tree in which sums and scatters merge.
DEPTH = 2
LARGEST, EDGE = 2**63 - 1, 2**52
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Model(NamedTuple):
    """Distinct vectors and their sums by dimension; eigenvalues, falling, and their unit vectors, as columns; the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n * x - sum) ** 2 over dimensions, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        gap = x - whole
        if (int(np.abs(gap).max(initial=0)) + 1) ** 2 * self.n**2 * max(1, len(self.sums)) < 2**63:
            return ((gap * self.n - rest) ** 2).sum(axis=1)
        return np.array([min(sum((int(g) * self.n - int(r)) ** 2 for g, r in zip(row, rest)), LARGEST) for row in gap], np.int64)


def jacobi(symmetric: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, as columns, of a symmetric positive semidefinite matrix, by cyclic Jacobi rotations. An entry counts as gone once it is
    below rounding against its two diagonal entries, so that eigenvalues much smaller than the largest one are accurate too."""
    a = np.array(symmetric, np.float64)
    size = len(a)
    axes = np.eye(size)
    for _ in range(sweeps):
        turned = False
        for p in range(size - 1):
            for q in range(p + 1, size):
                off = a[p, q]
                if off == 0.0 or abs(off) <= 2.0**-53 * math.sqrt(abs(a[p, p])) * math.sqrt(abs(a[q, q])):
                    continue
                turned = True
                ratio = (a[q, q] - a[p, p]) / (2 * off)
                tangent = math.copysign(1.0, ratio) / (abs(ratio) + math.hypot(1.0, ratio))
                cosine = 1 / math.hypot(1.0, tangent)
                sine = tangent * cosine
                low, high = a[p, p] - tangent * off, a[q, q] + tangent * off
                row_p, row_q = a[p].copy(), a[q].copy()
                a[p] = a[:, p] = cosine * row_p - sine * row_q
                a[q] = a[:, q] = sine * row_p + cosine * row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = low, high, 0.0, 0.0
                was = axes[:, p].copy()
                axes[:, p] = cosine * was - sine * axes[:, q]
                axes[:, q] = sine * was + cosine * axes[:, q]
        if not turned:
            break
    values = np.diagonal(a).copy()
    order = np.argsort(-values, kind="stable")
    return values[order], axes[:, order]


def whole(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x, the integers of each finite vector."""
    scaled = F.transform(V.doubles(column), lambda c: (F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(EDGE))), F.lit(float(EDGE)))) + OFFSET).cast("long"))
    kept = V.finite(vectors, column).select("vec_id", scaled.alias("x"))
    width = kept.agg(F.max(F.size("x"))).first()[0] or 0
    return kept.withColumn("x", F.when(F.size("x") < width, F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), width - F.size("x")))).otherwise(F.col("x")))


def rows_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def added(distinct: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum of `part` over blocks of x: within tasks first, then through a tree."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in V.blocks(batches):
            found = part(rows_of(batch.column("x")))
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"kind": pa.array([total.dtype.str]), "shape": pa.array([list(total.shape)], pa.list_(pa.int64())), "cells": pa.array([total.tobytes()], pa.binary())})

    parts = distinct.mapInArrow(tally, "kind string, shape array<long>, cells binary").rdd.map(lambda r: np.frombuffer(r["cells"], r["kind"]).reshape(r["shape"]))
    return parts.treeAggregate(None, lambda a, b: b if a is None else a + b, lambda a, b: b if a is None else a if b is None else a + b, DEPTH)


def fit(distinct: DataFrame, most: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors; None without variance. Sums are kept in two halves, so that they are exact for any number of rows."""
    halves = added(distinct, lambda x: np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), np.full(x.shape[1], len(x))]))
    if halves is None or not halves.shape[1]:
        return None
    bare = Model(int(halves[2, 0]), [(int(h) << 32) + int(low) for h, low in zip(halves[0], halves[1])], np.zeros(0), np.zeros((0, 0)), 0.0)

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = bare.centred(x)
        return centred.T @ centred

    covariance = added(distinct, scatter) / bare.n
    values, axes = jacobi(covariance)
    real = min(most, int((values > len(values) * 2.0**-52 * values[0]).sum()))
    return bare._replace(values=values[:real], axes=axes[:, :real], trace=float(np.trace(covariance))) if real and values[0] > 0 else None


def identity_error(distinct: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    mean = added(distinct, lambda x: model.whitened(x).sum(axis=0)) / model.n

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = model.whitened(x) - mean
        return centred.T @ centred

    return float(np.abs(added(distinct, scatter) / model.n - np.eye(len(model.values))).max())


def transformed(rows: DataFrame, model: Model, error: float) -> DataFrame:
    """A row for each vector and component."""
    held = rows.sparkSession.sparkContext.broadcast((model, error))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, error = held.value
        count = len(model.values)
        for batch in V.blocks(batches):
            x = rows_of(batch.column("x"))
            each = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(each), model.n, np.int64)),
                "deviation": pa.array(model.deviation(x)[each]),
                "whitened": pa.array(model.whitened(x).reshape(-1)),
                "explained": pa.array(np.tile(model.values / model.trace, len(x))),
                "identity_error": pa.array(np.full(len(each), error)),
            })

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(project, SCHEMA)


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Whitened components of all finite vectors."""
    rows = whole(vectors)
    distinct = C.staged(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return transformed(rows, model, identity_error(distinct, model))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(C.table(spark, sf_dir, "embeddings"))
