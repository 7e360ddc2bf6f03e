"""Whitening of embeddings by principal components of integer vectors.

The scatter of the distinct vectors is summed up from one small matrix per partition. A Cholesky factorisation with pivoting
turns it into a triangular factor, whose columns are rotated against each other (one-sided Jacobi) until they are orthogonal:
their squared norms are then the eigenvalues and their directions the components, to double precision, small ones included.
Only matrices of dimensions x dimensions reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import store
from feedloom.llm.vectors import decimals, longs, matrices, stored_vectors, sums

COMPONENTS = 16
#: A pivot below this share of the largest variance is rounding, not variance.
RANK = 1e-12
#: Dimensions up to which a scatter matrix is sent to the driver (128 MB).
MAX_DIMENSIONS = 4096


@dataclass(frozen=True)
class Centre:
    """The exact mean: ``total / n`` of each dimension, kept as whole part and remainder."""

    n: int
    total: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - total / n; the whole part is taken off before anything is rounded."""
        whole = np.array([t // self.n for t in self.total], np.int64)
        rest = np.array([t % self.n / self.n for t in self.total])
        return (x - whole).astype(float) - rest

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - total) squared, exact."""
        whole = np.array([t // self.n for t in self.total], np.int64)
        rest = [t % self.n for t in self.total]
        off = x - whole
        # |n * off - rest| < n * (|off| + 1)
        if x.shape[1] * (self.n * (int(np.abs(off).max(initial=0)) + 1)) ** 2 < 1 << 62:
            scaled = self.n * off - np.array(rest, np.int64)
            return (scaled * scaled).sum(axis=1)
        scaled = self.n * off.astype(object) - np.array(rest, object)
        return (scaled * scaled).sum(axis=1)


@dataclass(frozen=True)
class Whitening:
    """``components``: one unit column each, by falling ``eigenvalues``; ``explained``: their shares of all variance."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.components / np.sqrt(self.eigenvalues))


def pivoted_cholesky(v: np.ndarray, rank_tolerance: float = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order) with ``v[order][:, order] == factor @ factor.T``; the factor has one column per pivot above the tolerance."""
    d = len(v)
    left, order = v.astype(float).copy(), np.arange(d)
    factor = np.zeros((d, d))
    least = rank_tolerance * max(float(np.diag(v).max(initial=0.0)), 0.0)
    for k in range(d):
        pivot = k + int(np.argmax(np.diag(left)[k:]))
        if left[pivot, pivot] <= least:
            return factor[:, :k], order
        for a in (left, factor):
            a[[k, pivot]] = a[[pivot, k]]
        left[:, [k, pivot]] = left[:, [pivot, k]]
        order[[k, pivot]] = order[[pivot, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated against each other until all are orthogonal.

    Every round rotates disjoint pairs at once; as in a tournament, each pair meets once in a sweep.
    """
    a = np.array(factor.T)  # rows are contiguous
    k = len(a)
    seats = list(range(k)) + ([-1] if k % 2 else [])
    tiny = np.finfo(float).eps * np.sqrt(max(a.shape[1], 1))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(seats) - 1, 0)):
            pairs = np.array([(p, q) for p, q in zip(seats[: len(seats) // 2], seats[::-1]) if min(p, q) >= 0], np.int64).reshape(-1, 2)
            p, q = a[pairs[:, 0]], a[pairs[:, 1]]
            pp, qq, pq = (np.einsum("ij,ij->i", s, t) for s, t in ((p, p), (q, q), (p, q)))
            size = np.sqrt(pp * qq)
            turn = np.abs(pq) > tiny * size
            worst = max(worst, float((np.abs(pq)[turn] / size[turn]).max(initial=0.0)))
            slope = np.where(turn, (qq - pp) / np.where(turn, 2 * pq, 1.0), 0.0)
            t = np.where(turn, np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.hypot(1.0, slope)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[pairs[:, 0]], a[pairs[:, 1]] = c[:, None] * p - s[:, None] * q, s[:, None] * p + c[:, None] * q
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst == 0.0:
            break
    return a.T


def principal(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit columns; fewer if its rank is less."""
    factor, order = pivoted_cholesky(v)
    rotated = jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(axis=0))
    best = np.argsort(-norms, kind="stable")[:count]
    components = np.zeros((len(v), len(best)))
    components[order] = rotated[:, best] / norms[best]
    return norms[best] ** 2, components


def _summed(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dimensions
        for batch in batches:
            for _, x in matrices(batch, dimensions):
                total = [a + b for a, b in zip(total, sums(x))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), decimals(total)], ["place", "total"])

    return run


def centre_of(fit: DataFrame, dimensions: int) -> Centre:
    """Number of rows and exact column sums of (x)."""
    rows = fit.mapInArrow(_summed(dimensions), "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()
    return Centre(fit.count(), tuple(int(r.total) for r in rows))


def _scatter(prepare: Callable[[np.ndarray], np.ndarray], dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for _, x in matrices(batch, dimensions):
                z = prepare(x)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            at = pa.array(range(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([at, pa.array([row[i:] for i, row in enumerate(total)], pa.list_(pa.float64()))], ["i", "row"])

    return run


def covariance(fit: DataFrame, dimensions: int, n: int, prepare: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Mean of the outer products of the prepared, already centred rows: a partition sends its upper triangle, cells are added up."""
    parts = fit.mapInArrow(_scatter(prepare, dimensions), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (np.asarray(cells[c]) for c in ("i", "j", "v"))
    out = np.zeros((size, size))
    out[i, i + j] = out[i + j, i] = v / n
    return out


def learn(fit: DataFrame, dimensions: int, components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """The whitening of (x) and the largest entry of the whitened rows' covariance minus the identity. None without rows."""
    centre = centre_of(fit, dimensions)
    if not centre.n:
        return None
    v = covariance(fit, dimensions, centre.n, centre.centred, dimensions)
    eigenvalues, columns = principal(v, components)
    model = Whitening(centre, columns, eigenvalues, eigenvalues / max(float(np.trace(v)), np.finfo(float).tiny))
    k = len(eigenvalues)
    checked = covariance(fit, dimensions, centre.n, model.apply, k) if k else np.zeros((0, 0))
    return model, float(np.abs(checked - np.eye(k)).max(initial=0.0))


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(model: Whitening, error: float, dimensions: int):
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in matrices(batch, dimensions):
                rows = len(x)
                columns = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.centre.n)), longs(np.repeat(model.centre.deviation(x), k)), pa.array(model.apply(x).ravel()),
                    pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(embeddings: DataFrame, scale: int = 64, offset: int = 1_000_000, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become ``floor(scale * entry) + offset``; the model is of the distinct vectors, each once, n of them. Rows whose
    vector is null, empty or holds null, infinite or undefined entries are dropped, also those of another length than the
    commonest. Components number 1 and up to ``components`` or the rank; a table of one distinct vector has rank 0 and gives
    no rows, like an empty one. Repeated rows and null ids get rows of their own; other columns are not looked at. A
    deviation beyond long is null. Equal eigenvalues share a space in which the choice of components is free. More than
    ``MAX_DIMENSIONS`` dimensions are refused.
    """
    rows, dimensions = stored_vectors(embeddings, scale, offset, vector_column, "vectors", vec_id=id_column)
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    if dimensions > MAX_DIMENSIONS:
        raise ValueError(f"{dimensions} dimensions, more than {MAX_DIMENSIONS}: their scatter matrix would not fit the driver.")
    learned = learn(store(rows.select("x").distinct(), "distinct_vectors"), dimensions, components) if dimensions else None
    if learned is None or not len(learned[0].eigenvalues):
        return embeddings.sparkSession.createDataFrame([], _OUT)
    return rows.mapInArrow(_whitened(*learned, dimensions), _OUT)
