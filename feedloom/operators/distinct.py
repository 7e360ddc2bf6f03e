"""Distinct contents in two phases: narrow fingerprints of all rows, whole rows only where a fingerprint repeats.

Content is compared, not trusted to a hash: rows whose fingerprint occurs once are certainly different from all others and
pass without a shuffle; the rest are grouped by their columns. So shuffled bytes follow the number of repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.grouping import attach
from feedloom.session import materialize

#: Repeated fingerprints up to which they are sent to all tasks (two longs each, under 100 MB there); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_HIGH, _LOW, _FOUND = "_print_high", "_print_low", "_repeated"

Prints = Callable[[Sequence[Column]], tuple[Column, Column]]


def fingerprints(columns: Sequence[Column]) -> tuple[Column, Column]:
    """Two 64-bit hashes of the columns; where the nulls are counts too."""
    nulls = [c.isNull() for c in columns]
    return F.xxhash64(F.lit(1), *columns, *nulls), F.xxhash64(*nulls, F.lit(2), *columns)


def split_repeated(df: DataFrame, columns: Sequence[str], prints: Prints = fingerprints) -> tuple[DataFrame, DataFrame]:
    """Rows that are alone with their content, and rows that may not be; no row of one part equals one of the other."""
    high, low = prints([F.col(f"`{c}`") for c in columns])
    keyed = df.withColumns({_HIGH: high, _LOW: low})
    repeated = materialize(keyed.groupBy(_HIGH, _LOW).agg(F.count("*").alias(_FOUND)).where(F.col(_FOUND) > 1).select(_HIGH, _LOW, F.lit(True).alias(_FOUND)))
    known = F.broadcast(repeated) if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else repeated
    marked = keyed.join(known, [_HIGH, _LOW], "left")
    own = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(F.col(_FOUND).isNull()).select(*own), marked.where(F.col(_FOUND)).select(*own)


def distinct_rows(df: DataFrame, order_by: str, copies: str, prints: Prints = fingerprints) -> DataFrame:
    """One row per distinct content of all columns but ``order_by``, with the smallest ``order_by`` and the number of copies."""
    content = [c for c in df.columns if c != order_by]
    single, suspect = split_repeated(df, content, prints)
    grouped = suspect.groupBy(*[F.col(f"`{c}`") for c in content]).agg(F.min(order_by).alias(order_by), F.count("*").alias(copies))
    return single.withColumn(copies, F.lit(1).cast("long")).select(*grouped.columns).unionByName(grouped)


def surplus_rows(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), prints: Prints = fingerprints) -> DataFrame:
    """Per group the rows beyond the first of each content: ``surplus``. Groups without any are left out; without ``by``, one row."""
    _, suspect = split_repeated(df.select(*by, *[c for c in columns if c not in by]), [*by, *[c for c in columns if c not in by]], prints)
    copies = suspect.groupBy(*suspect.columns).agg(F.count("*").alias("_copies"))
    return copies.groupBy(*by).agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("long").alias("surplus"))


def distinct_counts(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "distinct") -> DataFrame:
    """Exact number of distinct non-null values per group."""
    known = df.where(F.col(f"`{column}`").isNotNull())
    totals = df.groupBy(*by).agg(F.count(f"`{column}`").alias("_known"))
    surplus = surplus_rows(known, [column], by)
    return attach(totals, surplus, by).select(*by, (F.col("_known") - F.coalesce("surplus", F.lit(0))).alias(name))


# ---- mergeable sketches: distinct counts of any union of days and segments without reading the rows again

#: Size of a sketch as a power of two; three standard errors of its estimate are within SKETCH_ERROR.
SKETCH_BITS, SKETCH_ERROR = 14, 0.025


def value_sketches(df: DataFrame, column: str, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Per day and group: rows and a sketch of the distinct values. Rows of this table are what is kept; they merge in any order."""
    return df.groupBy(F.to_date(date).alias("day"), *by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(column, SKETCH_BITS).alias("sketch"))


def estimated_distinct(sketches: DataFrame, by: Sequence[str] = (), name: str = "estimate") -> DataFrame:
    """Number of distinct values per group, within ``SKETCH_ERROR`` of the exact one in 997 of 1000 cases."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
