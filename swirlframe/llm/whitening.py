"""Embedding whitening: principal components by the distributed singular value decomposition of centred rows.

Each entry c becomes the integer x = floor(64 c) + 1,000,000, so that counts, sums and deviations are exact. A first pass adds up n and
every dimension's sum S. The rows x - S / n then go, as vectors and without Python, to MLlib's ``computeSVD``: a distributed sum of
outer products gives right singular vectors V and singular values s of the centred rows, and e = s^2 / n are the covariance's eigenvalues (divisor n).
The total variance comes apart from that from the exact squares of n x - S; the same pass adds up the covariance of the
whitened rows, whose distance from the identity is returned. A last pass writes a row for each vector and component.

A row's x - S / n is taken as (x - S // n) - (S % n) / n, whose first part is exact, so it is rounded once.

Defined results: vectors that are null, empty, hold null or non-finite entries or one whose x isn't a 64-bit integer are
left out; so are those of another length than the one of most usable rows (of equally many, the greater); repeated rows, and rows of equal or null ids,
count each and are returned each; components of no variance (singular value up to a millionth of the largest) have no whitened values and are left
out; without any variance, or in an empty table, there are no rows; ids are integers; other columns are not read. ``deviation`` beyond a 64-bit integer is null.

Memory: a task holds one batch and d x d sums; the driver d x d doubles (MLlib's own limit is 65,535 dimensions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

COMPONENTS, SCALE, SHIFT = 32, 64.0, 1_000_000
#: Singular values up to this share of the largest count as none. They are roots of a sum of outer products' eigenvalues, so smaller ones
#: are mostly rounding: from here on whitened rows are of unit variance within 1e-4.
NONE = 1e-6
_MOST = float(1 << 62)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>): rows whose entries are all finite numbers with an integer x, of any length over 0."""
    rows = only(vectors, vec_id=vec_id, v=embedding).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < _MOST)))


def _x(column: pa.Array) -> np.ndarray:
    """Integers of a batch's vectors, a row each."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _sums(rows: DataFrame, width: int) -> list[int]:
    """Exact sums of each dimension, a row a dimension from each task."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for part in parts:
            x = _x(part.column(0))
            safe = np.abs(x).max(initial=0) < (1 << 62) // max(1, len(x))
            total += (x if safe else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(width), pa.int32()), "total": pa.array([str(t) for t in total], pa.string())})

    sums = rows.select("v").mapInArrow(add, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return [int(r.total) for r in sums.orderBy("dim").collect()]


class Whitening:
    """n, dimension sums, components (columns of ``v``), eigenvalues, and what ``whitened`` needs of them."""

    def __init__(self, rows: DataFrame, width: int, n: int, most: int = COMPONENTS) -> None:
        self.n, self.sums = n, _sums(rows, width)
        self.mean, rest = np.array([s // n for s in self.sums], np.int64), [s % n for s in self.sums]
        self.rest_exact, self.rest = np.array(rest, object), np.array([r / n for r in rest])
        of = lambda numbers, kind: F.array(*[F.lit(v) for v in numbers]).cast(f"array<{kind}>")
        whole = F.zip_with("v", of(map(int, self.mean), "long"), lambda c, m: F.floor(F.lit(SCALE) * c).cast("long") + F.lit(SHIFT) - m)
        centred = F.zip_with(whole, of(map(float, self.rest), "double"), lambda x, r: x.cast("double") - r)
        matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("row")), "row"), n, width)
        self.values, self.v = np.zeros(0), np.zeros((width, 0))
        if self._varies(rows):
            svd = matrix.computeSVD(min(most, width), computeU=False, rCond=NONE)
            self.values = svd.s.toArray() ** 2 / n
            self.v = np.asarray(svd.V.toArray())
        self.trace = self.identity_error = 0.0
        if len(self.values):
            self._check(rows)

    def _varies(self, rows: DataFrame) -> bool:
        first = rows.select("v").first().v
        x = np.floor(SCALE * np.array(first)).astype(np.int64) + SHIFT
        same = all(int(a) * self.n == s for a, s in zip(x, self.sums, strict=True))
        return not same or not rows.filter(F.transform("v", lambda c: F.floor(F.lit(SCALE) * c).cast("long")) != F.array(*[F.lit(int(a) - SHIFT).cast("long") for a in x])).isEmpty()

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over a row's dimensions of (n x - S)^2."""
        off = x - self.mean
        far = int(np.abs(off).max(initial=0)) + 1
        if self.n * far < (1 << 31) and (self.n * far) ** 2 * x.shape[1] < (1 << 63):
            d = self.n * off - self.rest_exact.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * off.astype(object) - self.rest_exact
        return (d * d).sum(axis=1).tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.v / np.sqrt(self.values)

    def _check(self, rows: DataFrame) -> None:
        """Total variance from exact deviations; the whitened rows' covariance against the identity."""
        k = len(self.values)
        told = rows.sparkSession.sparkContext.broadcast(self)

        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, total, mean, square = told.value, 0, np.zeros(k), np.zeros((k, k))
            for part in parts:
                x = _x(part.column(0))
                w = own.whitened(x)
                total, mean, square = total + sum(own.deviations(x)), mean + w.sum(axis=0), square + w.T @ w
            yield pa.RecordBatch.from_pydict({"at": pa.array([-1, *range(k + k * k)], pa.int32()), "part": pa.array([0.0, *mean, *square.ravel()], pa.float64()), "whole": pa.array([str(total), *["0"] * (k + k * k)], pa.string())})

        got = rows.select("v").mapInArrow(add, "at int, part double, whole string").groupBy("at").agg(F.sum("part").alias("part"), F.sum(F.col("whole").cast("decimal(38,0)")).alias("whole")).orderBy("at").collect()  # 1 + k + k^2 rows
        self.trace = float(int(got[0].whole)) / self.n / self.n / self.n if got[0].whole is not None else float("nan")
        mean = np.array([r.part for r in got[1 : k + 1]]) / self.n
        square = np.array([r.part for r in got[k + 1 :]]).reshape(k, k) / self.n
        self.identity_error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error of every usable row."""
    spark, rows = vectors.sparkSession, usable(vectors, vec_id, embedding)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    width, n = sizes[0].width, sizes[0].n
    rows = rows.filter(F.size("v") == width)
    model = Whitening(rows, width, n, most)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], schema)
    told = spark.sparkContext.broadcast(model)  # d x (k + 3) numbers

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        share = own.values / own.trace
        for part in parts:
            for at in range(0, part.num_rows, 2048):
                some = part.slice(at, 2048)
                x = _x(some.column(1))
                m = len(x)
                far = [d if d < 1 << 63 else None for d in own.deviations(x)]
                index = pa.array(np.repeat(np.arange(m), k))
                columns = [some.column(0).take(index), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own.n)), pa.array(far, pa.int64()).take(index), pa.array(own.whitened(x).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, own.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
