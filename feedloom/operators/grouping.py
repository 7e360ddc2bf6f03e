"""Shared shapes: optional segment columns, one-row frames, top-k and modes.

Every summary operator takes ``by``: extra grouping columns. With none, the whole table is one group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_ONE, _OUTPUTS = "_one", "_outputs"


def computed_once(df: DataFrame, keep: Sequence[str], outputs: Sequence[Column]) -> DataFrame:
    """``keep`` columns plus the outputs, each evaluated once per row.

    Spark copies an expression into every filter or Python UDF input above it; for a long chain the copies multiply
    and planning takes minutes. A one-row ``inline`` ends that: filters on ``keep`` columns still move below it,
    filters on the outputs stay above. The outputs are projected below it: inside a generator Spark would interpret them
    and compute what they share again for each.
    """
    return df.select(*keep, F.struct(*outputs).alias(_OUTPUTS)).select(*keep, F.inline(F.array(_OUTPUTS)))


def window(by: Sequence[str], *order: Column) -> WindowSpec:
    """Window per group. Without ``by`` it spans the frame, so use it on aggregated frames only."""
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return spec.orderBy(*order) if order else spec


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches null keys; the right keys are dropped."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_right_{k}"), keys, right)
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def without_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the left frame whose keys the right one does not have; null keys match null keys."""
    names = {k: f"_right_{k}" for k in keys}
    renamed = right.select(*[F.col(k).alias(n) for k, n in names.items()])
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]), "left_anti")


def with_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the left frame whose keys the right one has; null keys match null keys, and without keys all match."""
    if not keys:
        return left
    names = {k: f"_right_{k}" for k in keys}
    renamed = right.select(*[F.col(k).alias(n) for k, n in names.items()])
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]), "left_semi")


def attach(df: DataFrame, one_per_group: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Add the columns of a frame that has one row per ``by`` group (or one row in all)."""
    if by:
        return null_safe(df, one_per_group, by, how)
    return df.withColumn(_ONE, F.lit(1)).join(one_per_group.withColumn(_ONE, F.lit(1)), _ONE, how).drop(_ONE)


def with_group_value(df: DataFrame, source: DataFrame, by: Sequence[str], name: str, value: Column) -> DataFrame:
    """Add an aggregate of ``source`` to every row: a scalar subquery, or a join on the group columns."""
    if not by:
        return df.withColumn(name, source.select(value).scalar())
    return attach(df, source.groupBy(*by).agg(value.alias(name)), by)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows per key in the given order; each input partition is cut to ``k`` before the shuffle."""
    return df.withColumn(rank, F.row_number().over(window(keys, *order))).filter(F.col(rank) <= k)


def distinct_values(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Every distinct trimmed non-blank value of the named columns per group, one row each: keys, name, value, rows."""
    from feedloom.functions.text import blank_to_null

    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), blank_to_null(c).alias("value")) for name, c in columns.items()]))
    found = df.select(*keys, cells.alias("_cell")).select(*keys, "_cell.*").where(F.col("value").isNotNull())
    return found.groupBy(*keys, "name", "value").agg(F.count("*").alias("rows"))


def value_lists(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column], *, limit: int | None = None) -> DataFrame:
    """Per group the distinct values of each named column in order, as arrays: all of them, or the first ``limit``.

    Values are counted as rows, spread over tasks by value; only distinct ones meet in the row that holds their list. With a
    limit every partition keeps ``limit`` of them. Groups without a value are left out; see ``with_lists``.
    """
    values = distinct_values(df, keys, columns)
    if limit is not None:
        values = top_per_group(values, [*keys, "name"], [F.asc("value")], limit, "_rank")
    lists = [F.sort_array(F.collect_list(F.when(F.col("name") == name, F.col("value")))).alias(name) for name in columns]
    return values.groupBy(*keys).agg(*lists)


def with_lists(groups: DataFrame, df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column | None], *, limit: int | None = None) -> DataFrame:
    """Add to one row per group the lists of ``value_lists``; empty where there is no value or no such column."""
    none = F.array().cast("array<string>")
    present = {name: c for name, c in columns.items() if c is not None}
    joined = null_safe(groups, value_lists(df, keys, present, limit=limit), keys) if present else groups
    return joined.withColumns({name: F.coalesce(F.col(name), none) if name in present else none for name in columns})


def ids_in_rank_order(rank: str, value: str) -> Column:
    """Aggregate over a few ranked rows: the values as a list in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(value).cast("string").alias("value"))))
    return F.transform(pairs, lambda p: p["value"])


def optional(df: DataFrame, name: str, default=None, data_type: str = "string") -> Column:
    """The column, or a typed default where the table does not have it."""
    return F.col(name) if name in df.columns else F.lit(default).cast(data_type)
