"""Whitening of embeddings by shifted CholeskyQR.

The centred rows X of the fit list are never collected. Passes over them, each one Spark job that returns a matrix of the
vectors' dimension, orthogonalise them: a pass sums the Gram matrix of X (R1)^-1 ... (Rk)^-1, whose rows each task makes by triangular solves with
the factors so far, and its Cholesky factor is the next one. The first passes shift the Gram matrix by a multiple
of the rounding error, so that it has a factor however ill-conditioned X is. The composed R = Rk ... R1 has the
singular values and right vectors of X, which the driver takes from it. A last pass measures the whitened rows' covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, table
from .topk import usable

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Rows that a task works on at once.
ROWS = 4096
#: Eigenvalues of less than this share of the greatest are zero: rounding leaves such ones in directions that the fit list does not span.
ZERO = 1e-20
#: Whole numbers of at least this size are not exact as doubles.
LARGEST = float(2**53)


@dataclass
class Whitening:
    """A fitted model: ``n`` vectors, their sums by dimension, eigenvalues (falling) and eigenvectors (columns) of the covariance with divisor ``n``."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    identity_error: float

    def __post_init__(self) -> None:
        floor = [s // self.n for s in self.sums]
        self.floor = np.array(floor, np.int64)
        self.rest = np.array([s - self.n * f for s, f in zip(self.sums, floor, strict=True)], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``: a whole number near the mean is taken off exactly, before the rest, which is below one."""
        return (x - self.floor) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """``sum (n x - S)^2`` of each row, exact; None where 64 bits do not hold it."""
        top = max(np.abs(x - self.floor).max(initial=0).item() + 1, 1) * self.n
        if x.shape[1] * top * top < 2**63:
            return ((self.n * (x - self.floor) - self.rest) ** 2).sum(axis=1).tolist()
        whole = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [d if d < 2**63 else None for d in whole]

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """Projections on the first ``components``, over the root of their eigenvalue; NaN where that is zero."""
        scale = np.sqrt(self.eigenvalues[:components])
        return np.divide(self.centred(x) @ self.components[:, :components], scale, where=scale > 0, out=np.full((len(x), components), np.nan))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield np.frombuffer(b"".join(batch.column("x").slice(k, ROWS).to_pylist()), np.int64).reshape(-1, dim)


def solve(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``x r^-1`` for an upper triangular ``r``, column by column."""
    out = np.empty_like(x)
    for j in range(x.shape[1]):
        out[:, j] = (x[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(fit: DataFrame, dim: int, rows, width: int) -> np.ndarray:
    """The sum over the fit list of ``y^T y`` for ``y = rows(x)``; each task adds up its own, Spark the tasks' entries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for x in _matrices(batches, dim):
            y = rows(x)
            total += y.T @ y
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])
        release()

    out = np.zeros((width, width))
    for r in fit.mapInArrow(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():  # the dimension's square at most
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def factor(g: np.ndarray, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix; ``shifted``, or if there is none otherwise, of ``g`` plus a multiple of the rounding error."""
    dim = len(g)
    shift = 11 * dim * (dim + 1) * np.finfo(float).eps * max(np.trace(g), np.finfo(float).tiny)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    return np.linalg.cholesky(g + shift * np.eye(dim)).T


def fit_whitening(distinct: DataFrame, dim: int, components: int, passes: int = 3) -> Whitening:
    """Fit on the rows of ``distinct(x)``, one at least; ``x`` is ``dim`` 64-bit whole numbers as bytes.

    Sums are exact. Each pass reads all rows again: give a written table. ``identity_error`` is measured on the first ``components``.
    """

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, object)
        for x in _matrices(batches, dim):
            n += len(x)
            # halves of 32 bits, so that no sum of ROWS of them leaves 64 bits
            sums += ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim), pa.array([str(s) for s in sums])], names=["d", "n", "s"])

    found = distinct.mapInArrow(totals, "d int, n long, s string").groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted(found.collect())  # a row a dimension
    model = Whitening(found[0]["n"], [int(r["s"]) for r in found], np.zeros(dim), np.eye(dim), 0.0)
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        y = model.centred(x)
        for r in factors:
            y = solve(y, r)
        return y

    whole = np.eye(dim)
    for k in range(passes):
        r = factor(gram(distinct, dim, orthogonal, dim), shifted=k == 0)
        factors.append(r)
        whole = r @ whole
    _, singular, right = np.linalg.svd(whole)
    values = singular**2 / model.n
    values[values <= values[0] * ZERO] = 0
    vectors = right.T * np.where(right.T[np.abs(right.T).argmax(axis=0), np.arange(dim)] < 0, -1, 1)  # the greatest entry is positive
    model.eigenvalues, model.components = values, vectors
    used = np.flatnonzero(values[:components] > 0)
    if len(used):
        covariance = gram(distinct, dim, lambda x: model.whitened(x, components)[:, used], len(used)) / model.n
        model.identity_error = float(np.abs(covariance - np.eye(len(used))).max())
    return model


def whiten(rows: DataFrame, components: int = 16, scale: float = 64, offset: int = 1_000_000) -> DataFrame:
    """Whitened vectors: a row for each usable row of ``rows(vec_id, embedding)`` and each of the first ``components`` components.

    Entries c count as the whole numbers ``x = floor(scale * c) + offset``. The fit list is each distinct vector once: ``n`` of them with sums S.
    ``component``: from 1, by falling eigenvalue of the fit list's covariance (divisor n), with the greatest entry of the eigenvector positive; as many as dimensions
    at most. ``deviation``: sum of (n x - S)^2, exact, null where 64 bits do not hold it. ``whitened``: the centred vector's projection over the root of the
    eigenvalue, null where that is zero. ``explained``: the eigenvalue's share of all (zero if all are). ``identity_error``: the largest entry of the
    whitened fit list's measured covariance minus the identity, components of eigenvalue zero left out.

    Vectors that are null, or hold null or non-finite entries or ones whose x is 2**53 or more, have no rows. Shorter vectors count as padded with zeros. Repeated rows and null or
    repeated vec_ids are rows of their own; other columns are not read. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & ~F.exists("v", lambda c: F.abs(c * scale) >= LARGEST))
    dim = good.agg(F.max(F.size("v"))).first()[0] or 0
    if not dim:
        return spark.createDataFrame([], SCHEMA)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("v")).to_numpy()
            x = np.zeros((batch.num_rows, dim))
            x[np.arange(dim)[None, :] < size[:, None]] = batch.column("v").flatten().to_numpy()
            x = np.floor(scale * x).astype(np.int64) + offset
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "x"])

    vectors = good.mapInArrow(numbers, "vec_id long, x binary")
    k = min(components, dim)
    model = fit_whitening(cut(vectors.select("x").distinct()), dim, k)
    total = model.eigenvalues.sum()
    explained = (model.eigenvalues[:k] / total if total > 0 else np.zeros(k)).tolist()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.int64).reshape(-1, dim)
                n = len(x)
                at = pa.array(np.repeat(np.arange(n), k))
                columns = [part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(at)]
                columns += [pa.array(model.whitened(x, k).ravel(), pa.float64(), from_pandas=True), pa.array(explained * n, pa.float64()), pa.array(np.full(n * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in SCHEMA.split(", ")])
        release()

    return vectors.mapInArrow(rows_of, SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
