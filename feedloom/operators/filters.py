"""Filtering analysed feedback and listing the values to filter on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.vocab.columns import FILTERABLE
from feedloom.vocab.themes import NON_PAIN_THEMES


def apply_filters(df: DataFrame, selected: Mapping | None = None, *, inclusive_end_day: bool = False) -> DataFrame:
    """AND of a date range and value lists; an empty list or an absent column does not filter, null never matches.

    The range ends at midnight of its last day, so times later that day fall outside unless ``inclusive_end_day``.
    The predicates are plain comparisons on stored columns, so they reach the file scan.
    """
    for name, values in (selected or {}).items():
        if name == "date_range":
            if values and "date" in df.columns:
                start, end = (_midnight(v) for v in values)
                kept = F.col("date") >= F.lit(start).cast("timestamp_ntz")
                if inclusive_end_day:
                    kept = kept & (F.col("date") < F.lit(end + timedelta(days=1)).cast("timestamp_ntz"))
                else:
                    kept = kept & (F.col("date") <= F.lit(end).cast("timestamp_ntz"))
                df = df.filter(kept)
        elif name in FILTERABLE and values and name in df.columns:
            df = df.filter(F.col(name).isin(list(values)))
    return df


def _midnight(value) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(str(value))


def dated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("date").isNotNull())


def pain_only(df: DataFrame, theme: str = "theme") -> DataFrame:
    return df.filter(~F.col(theme).isin(*NON_PAIN_THEMES))


def filter_options(df: DataFrame, columns: Sequence[str] = FILTERABLE) -> DataFrame:
    """Every value of the filterable columns with its row count and its place in string order.

    A long table, so a column with very many values stays distributed.
    """
    present = [c for c in columns if c in df.columns]
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in present
    ]))
    return (
        df.select(cells.alias("cell")).select("cell.*").filter(F.col("value").isNotNull())
        .groupBy("dimension", "value").agg(F.count("*").alias("rows"))
    )


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.to_date(F.min("date")).alias("first_day"), F.to_date(F.max("date")).alias("last_day"))
