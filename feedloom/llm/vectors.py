"""Integer vectors of an embeddings table, and sums over them that stay exact.

Embeddings are scaled, floored and held as long; sums and squares use int64 where the largest value proves that they fit and
Python integers otherwise, so results do not depend on the size of entries or on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import store

#: Scaled entries beyond this size count as this size.
LIMIT = 1 << 61
#: Values of a batch that are worked on at once.
CHUNK = 1 << 19


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds no null and no infinite or undefined entry."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale * entry) + offset of each entry."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))) + F.lit(offset).cast("long"))


def stored_vectors(embeddings: DataFrame, scale: int, offset: int, vector_column: str, name: str, **columns: str) -> tuple[DataFrame, int]:
    """The usable rows as (own columns, x), written once, and the number of dimensions.

    That is the commonest length, of equally common ones the largest; rows of another length and empty vectors are left out.
    A table without a usable row has 0 dimensions and no rows.
    """
    vector = F.col(f"`{vector_column}`")
    rows = embeddings.where(usable(vector) & (F.size(vector) > 0))
    rows = store(rows.select(*[F.col(f"`{source}`").alias(own) for own, source in columns.items()], scaled(vector, scale, offset).alias("x")), name)
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common.d if common else 0)), common.d if common else 0


def matrices(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Row runs of a batch with their vectors as one matrix of int64."""
    step = max(1, CHUNK // max(dimensions, 1))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, np.asarray(part.column("x").flatten()).reshape(part.num_rows, dimensions)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))


def fits(x: np.ndarray, terms: int, squared: bool = False) -> bool:
    """Whether sums of so many entries, or of their squares, stay inside int64."""
    size = largest(x)
    return terms * (size * size if squared else size) < 1 << 62


def sums(x: np.ndarray) -> list[int]:
    """Sum of each column."""
    total = x.sum(axis=0) if fits(x, len(x)) else x.astype(object).sum(axis=0)
    return [int(t) for t in total]


def decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def longs(values: np.ndarray) -> pa.Array:
    """As long; null where a value does not fit."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())
