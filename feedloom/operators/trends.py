"""Date-aware trends. One pass over the feedback builds a day x theme table; every trend output derives from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import week_ending
from feedloom.functions.numbers import clamp, smoothed_growth
from feedloom.operators.filters import pain_only
from feedloom.operators.grouping import top_per_group, window

MIN_COVERAGE_DAYS = 14


def day_theme_volume(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and negative rows per day and theme (A11). Its size is days x themes, whatever the input size."""
    return (
        df.filter(F.col("date").isNotNull())
        .groupBy(*by, F.to_date("date").alias("day"), "primary_theme")
        .agg(F.count("*").alias("feedback_count"), F.count_if(F.col("sentiment") == "Negative").alias("negative_count"))
    )


def theme_volume(volume: DataFrame, by: Sequence[str] = (), themes: Sequence[str] | None = None) -> DataFrame:
    rows = volume.filter(F.col("primary_theme").isNotNull())
    if themes:
        rows = rows.filter(F.col("primary_theme").isin(list(themes)))
    return rows.select(*by, "day", "primary_theme", "feedback_count")


def daily_volume(volume: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and negative percentage per day with data."""
    return volume.groupBy(*by, "day").agg(
        F.sum("feedback_count").alias("feedback_count"),
        (F.sum("negative_count") * 100.0 / F.sum("feedback_count")).alias("negative_percentage"),
    )


def weekly_volume(volume: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weeks ending Monday, from the first to the last, empty ones included: count 0, percentage null."""
    weeks = volume.withColumn("week", week_ending(F.col("day"))).groupBy(*by, "week").agg(
        F.sum("feedback_count").alias("_count"), F.sum("negative_count").alias("_negative")
    )
    filled = _filled(weeks, by, "week", 7)
    own = F.col("week") == F.col("_own")
    return filled.select(
        *by, "week",
        F.when(own, F.col("_count")).otherwise(0).alias("feedback_count"),
        F.when(own, F.col("_negative") * 100.0 / F.col("_count")).alias("negative_percentage"),
    )


def _filled(rows: DataFrame, by: Sequence[str], period: str, days: int) -> DataFrame:
    """Every row once per period from its own (kept as ``_own``) up to the next row's. No second pass over the source."""
    following = F.date_sub(F.lead(period).over(window(by, F.col(period))), days)
    periods = F.sequence(F.col(period), F.coalesce(following, F.col(period)), F.expr(f"interval {days} days"))
    rows = rows.filter(F.col(period).isNotNull()).withColumn("_periods", periods)
    return rows.select(*[c for c in rows.columns if c not in ("_periods", period)], F.col(period).alias("_own"), F.explode("_periods").alias(period))


def calendar_week_negative(volume: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weeks with data, labelled by their first day (Tuesday); nothing unless at least two weeks have data."""
    weeks = volume.withColumn("week_start", F.date_sub(week_ending(F.col("day")), 6)).groupBy(*by, "week_start").agg(
        F.sum("feedback_count").alias("total_feedback"), F.sum("negative_count").alias("negative_count")
    )
    return (
        weeks.withColumn("_weeks", F.count("*").over(window(by))).filter("_weeks >= 2").drop("_weeks")
        .withColumn("negative_percentage", F.col("negative_count") * 100.0 / F.col("total_feedback"))
    )


def adaptive_volume(volume: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily volume, or weekly volume (empty weeks 0) where more than 180 days are covered."""
    days = daily_volume(volume, by).withColumn("_coverage", coverage_days(by))
    daily = days.filter("_coverage <= 180").select(
        *by, F.lit("Daily").alias("aggregation"), F.col("day").alias("period"), "feedback_count"
    )
    long = days.filter("_coverage > 180").select(*by, "day", "feedback_count", F.lit(0).alias("negative_count"))
    weekly = weekly_volume(long, by).select(
        *by, F.lit("Weekly").alias("aggregation"), F.col("week").alias("period"), "feedback_count"
    )
    return daily.unionByName(weekly)


def coverage_days(by: Sequence[str] = ()):
    """Days from the first to the last day, over a per-day frame."""
    return F.datediff(F.max("day").over(window(by)), F.min("day").over(window(by))) + 1


def rolling_volume(volume: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """7-day mean over zero-filled days, full weeks only, for 14 to 180 days of coverage and 10 days with data."""
    days = daily_volume(volume, by).select(*by, "day", "feedback_count").withColumns({
        "_coverage": coverage_days(by), "_days": F.count("*").over(window(by)),
    })
    days = days.filter(F.col("_coverage").between(MIN_COVERAGE_DAYS, 180) & (F.col("_days") >= 10))
    filled = _filled(days, by, "day", 1).withColumn("feedback_count", F.when(F.col("day") == F.col("_own"), F.col("feedback_count")).otherwise(0))
    week = window(by, F.col("day")).rowsBetween(-6, 0)
    return filled.select(
        *by, "day",
        F.avg("feedback_count").over(week).alias("rolling_mean"),
        F.count("*").over(week).alias("_frame"),
    ).filter("_frame = 7").drop("_frame")


def window_growth(volume: DataFrame, by: Sequence[str] = (), period_days: int = 14) -> DataFrame:
    """Mark the days of the recent and the previous period; neither where fewer than 14 days are covered."""
    recent_start = F.date_sub(F.col("_end"), period_days - 1)
    previous_start = F.date_sub(F.col("_end"), 2 * period_days - 1)
    covered = F.col("_coverage") >= MIN_COVERAGE_DAYS
    marked = volume.select("*", F.max("day").over(window(by)).alias("_end"), coverage_days(by).alias("_coverage"))
    return marked.withColumns({
        "_recent": covered & (F.col("day") >= recent_start),
        "_previous": covered & (F.col("day") >= previous_start) & (F.col("day") < recent_start),
    })


def theme_trends(volume: DataFrame, by: Sequence[str] = (), *, period_days: int = 14) -> DataFrame:
    """Recent against previous period per theme; neutral values where fewer than 14 days are covered."""
    def counted(flag: str):
        return F.sum(F.when(F.col(flag), F.col("feedback_count")).otherwise(0))

    marked = window_growth(volume, by, period_days)
    counts = marked.filter(F.col("primary_theme").isNotNull()).groupBy(*by, F.col("primary_theme").alias("theme")).agg(
        counted("_recent").alias("recent_count"), counted("_previous").alias("previous_count"),
        F.max("_coverage").alias("coverage_days"),
    )
    growth = smoothed_growth(F.col("recent_count"), F.col("previous_count"))
    return counts.select(
        *by, "theme", "recent_count", "previous_count",
        growth.alias("growth_rate"),
        clamp(growth * 50 + 50).alias("trend_score"),
        ((F.col("recent_count") - F.col("previous_count")) / F.lit(float(period_days))).alias("issue_velocity"),
        "coverage_days",
    )


def fastest_growing(trends: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The pain theme with the highest trend score; no row where coverage is short."""
    order = [F.desc("trend_score"), F.desc("recent_count"), F.asc("theme")]
    eligible = pain_only(trends).filter(F.col("coverage_days") >= MIN_COVERAGE_DAYS)
    return top_per_group(eligible, by, order, 1, "_rank").select(*by, F.col("theme").alias("fastest_growing_pain_point"))
