"""Writing results as CSV or JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StructType

from feedloom.functions.numbers import finite


def write_csv(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """UTF-8 CSV with a header; ``partition_by`` writes one folder per value, e.g. per theme."""
    writer = df.write.mode(mode).option("header", "true").option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def canonical_json(df: DataFrame) -> Column:
    """The row as one JSON object: fields in name order at every level, nulls kept, NaN and infinities as null."""
    return F.to_json(
        F.struct(*[_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in _by_name(df.schema)]),
        {"ignoreNullFields": "false"},
    )


def _by_name(schema: StructType):
    return sorted(schema.fields, key=lambda f: f.name)


def _canonical(c: Column, data_type: DataType) -> Column:
    if isinstance(data_type, StructType):
        inner = F.struct(*[_canonical(c[f.name], f.dataType).alias(f.name) for f in _by_name(data_type)])
        return F.when(c.isNotNull(), inner)
    return finite(c) if isinstance(data_type, DoubleType | FloatType) else c


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.select(canonical_json(df).alias("value")).write.mode(mode).text(path)
