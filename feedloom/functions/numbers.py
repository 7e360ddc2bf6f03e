"""Numeric expressions: guarded parsing, half-even rounding, bounded scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import trim_ws

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def parse_number(c: Column) -> Column:
    """String to double; anything that is not a plain number is null (Spark alone accepts '4d' and 'NaN')."""
    text = trim_ws(c.cast("string"))
    infinite = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(NUMBER), text.try_cast("double")).when(text.rlike(INFINITE), infinite)


def in_rating_range(c: Column) -> Column:
    return c.between(1, 5)


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.abs(F.nanvl(c, F.lit(float("inf")))) < F.lit(float("inf")), c)


def safe_float(c: Column, digits: int = 4) -> Column:
    return F.bround(finite(c.cast("double")), digits)


def safe_share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part / whole, 4)).otherwise(F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def priority_label(score: Column) -> Column:
    s = clamp(score)
    return (
        F.when(s >= 80, "P0 Critical").when(s >= 60, "P1 High").when(s >= 40, "P2 Medium").otherwise("P3 Low")
    )


def trend_direction(growth: Column) -> Column:
    return (
        F.when(growth > 0.05, "growing").when(growth < -0.05, "declining").when(growth.isNotNull(), "stable")
    )


def smoothed_growth(recent: Column, previous: Column) -> Column:
    """(recent - previous) / (previous + 1), held within [-1, 1]."""
    return clamp((recent - previous) / (previous + F.lit(1.0)), -1.0, 1.0)


def share_pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))
