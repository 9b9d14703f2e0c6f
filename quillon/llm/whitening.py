"""Embedding whitening: covariances by Chan's merging, components by an eigendecomposition on the driver.

A vector's entries become whole numbers on a fixed grid. The fit list, each distinct vector once, is written as a table. Each of its
parts is reduced to its count, exact sums and the scatter about its own mean; two such triples are merged by Chan's formula, the distance between
means being taken from the exact sums, in treeReduce, so the driver gets one d x d matrix. A second pass over the fit list whitens it and
merges the covariance of the result in the same way: its largest deviation from the identity is reported with each row.

Defined results: rows whose vector is null, empty, holds a null or a non-finite entry, or one whose grid number is beyond 2**62, are dropped, and so are vectors of
another length than most rows have (the longer, if two are as frequent); a null vec_id is kept; repeated rows are given each, and count once in the fit list;
a component without variance (an eigenvalue within rounding of 0) has null `whitened` and `explained` 0; a deviation beyond 64 bits is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, scratch

GRID, OFFSET, COMPONENTS = 64, 1_000_000, 16
_FAR = float(2**62)


def gridded(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vector on the grid, of the rows that remain."""
    entry = F.col("embedding").cast("array<double>")
    fine = F.forall(entry, lambda c: F.coalesce(F.abs(c * GRID) < _FAR, F.lit(False)))  # NaN is over every number
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entry, lambda c: F.floor(c * GRID) + OFFSET).alias("x"))
    most = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (most["size"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def merged(a: tuple | None, b: tuple | None) -> tuple | None:
    """Two of (count, exact sums, scatter about the mean) as one."""
    if a is None or b is None:
        return b if a is None else a
    (n, s, x), (m, t, y) = a, b
    apart = np.array([(tj * n - sj * m) / (n * m) for sj, tj in zip(s, t)])  # of whole numbers, rounded once
    return n + m, [sj + tj for sj, tj in zip(s, t)], x + y + np.outer(apart, apart) * (n * m / (n + m))


def _of_grid(x: np.ndarray) -> tuple:
    """The triple of vectors on the grid; sums in Python's whole numbers where 64 bits could overflow."""
    wide = len(x) * max(abs(int(x.max())), abs(int(x.min()))) >= 2**62
    sums = [int(v) for v in x.sum(0, dtype=object if wide else np.int64)]
    about = x - x[0] if not wide else x.astype(float) - x[0].astype(float)  # whole and small, so the mean of it is exact enough
    about = about - about.mean(0)
    return len(x), sums, about.T @ about


def _of_values(w: np.ndarray) -> tuple:
    mean = w.mean(0)
    return len(w), w.sum(0).tolist(), (w - mean).T @ (w - mean)


def _reduced(rows: DataFrame, of) -> tuple | None:
    """The triples that `of` makes of each part's vectors, merged in a tree over the executors."""

    def parts(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                held = merged(held, of(_matrix(batch.column(0))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["held"])

    found = map_arrow(rows.select("x"), parts, "held binary").rdd.map(lambda r: pickle.loads(r.held))
    return found.treeReduce(merged) if found.getNumPartitions() else None


def components(n: int, scatter: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, falling, and unit eigenvectors as rows, `most` at most, of the covariance; its trace. An eigenvalue within rounding of 0 is 0."""
    v = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most].T
    values = np.where(values > len(v) * np.finfo(float).eps * max(float(values[0]), 0.0), values, 0.0)
    return values, np.ascontiguousarray(vectors), float(np.trace(v))


class Whitening:
    """What a fit list gives: n, sums, eigenvalues, eigenvectors, explained shares, and the second pass's identity_error."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, most: int):
        self.n, self.sums = n, sums
        self.values, self.vectors, trace = components(n, scatter, most)
        self.explained = self.values / trace if trace > 0 else np.zeros(len(self.values))
        self.identity_error = 0.0

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: 64-bit numbers, or Python's where those could overflow."""
        far = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))
        return x.astype(object) * self.n - np.array(self.sums, object) if far >= 2**62 else x * self.n - np.array(self.sums, np.int64)

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        """On the components, at unit variance; 0 where there is none."""
        scale = np.divide(1.0, np.sqrt(self.values), out=np.zeros(len(self.values)), where=self.values > 0)
        return (apart.astype(float) / self.n) @ self.vectors.T * scale


def deviations(apart: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exactly; None beyond 64 bits."""
    if apart.dtype == object or float((apart.astype(float) ** 2).sum(1).max()) >= 2.0**62:
        return [d if d < 2**63 else None for d in (sum(v * v for v in row) for row in apart.tolist())]
    return (apart * apart).sum(1).tolist()


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """From the distinct x of rows(x); None if there are none."""
    distinct = scratch(rows.select("x").distinct(), "fit-list")
    found = _reduced(distinct, _of_grid)
    if found is not None:
        model = Whitening(*found, most)
        n, _, scatter = _reduced(distinct, lambda x: _of_values(model.whitened(model.apart(x))))
        live = model.values > 0
        model.identity_error = float(np.abs((scatter / n)[np.ix_(live, live)] - np.eye(live.sum())).max(initial=0.0))
        found = model
    forget(distinct)
    return found


_ROW = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_ROW_KINDS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each row of vectors(vec_id, embedding) and component, by falling variance: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = gridded(vectors)
    model = fit(rows, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _ROW_KINDS)

    def run(batches):
        k = len(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                apart = model.apart(_matrix(part.column(1)))
                each, no = part.num_rows, np.tile(model.values <= 0, part.num_rows)
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(each), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), each)),
                    pa.array(np.full(each * k, model.n)),
                    pa.array(deviations(apart), pa.int64()).take(pa.array(np.repeat(np.arange(each), k))),
                    pa.array(model.whitened(apart).ravel(), mask=no),
                    pa.array(np.tile(model.explained, each)),
                    pa.array(np.full(each * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_ROW)

    return map_arrow(rows, run, _ROW_KINDS)
