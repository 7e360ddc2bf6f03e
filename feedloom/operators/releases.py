"""Release operators: version order, as-of version look-up and release stories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.numbers import safe_float
from feedloom.functions.text import blank_to_null
from feedloom.operators.grouping import ids_in_rank_order, null_safe, optional, top_per_group, window

# The (theme, platform) pairs watched by default, and the smallest change worth telling.
WATCHED = (("App Performance", "Android"), ("Payment and Checkout", None))
MIN_CHANGE = 0.05


def version_key(version: Column) -> Column:
    """Sortable key: the dotted parts as integers, or [0] if any part is not an integer."""
    parts = F.transform(F.split(version, "[.]"), lambda p: p.try_cast("int"))
    return F.when(F.exists(parts, lambda p: p.isNull()), F.array(F.lit(0))).otherwise(parts)


def fill_release(df: DataFrame, releases: DataFrame, date: str = "date", *, name: str = "expected_version") -> DataFrame:
    """The newest release on or before each date (backward as-of join); null before the first release.

    One plan for calendars of every size. A day keeps one release, of several the one whose version sorts last as text, so
    a month holds at most 31; each month starts from the last release before it, and rows join their month. Releases
    without a date are never current. Whether the table of months is broadcast follows from its measured size.
    """
    day = F.to_date(F.col(date))
    month = F.trunc(day, "month")
    days = (
        releases.select(F.to_date("released").alias("_released"), "version").filter(F.col("_released").isNotNull())
        .groupBy("_released").agg(F.max("version").alias("version")).withColumn("_month", F.trunc("_released", "month"))
    )
    inside = days.groupBy("_month").agg(F.array_sort(F.collect_list(F.struct("_released", "version"))).alias("_inside"))
    months = df.select(month.alias("_month")).filter(F.col("_month").isNotNull()).distinct()
    timeline = months.join(inside, "_month", "full")
    last = F.try_element_at("_inside", F.lit(-1))["version"]
    # One row per calendar month.
    before = F.last(last, ignorenulls=True).over(Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1))
    starts = timeline.select("_month", "_inside", before.alias("_before"))
    earlier = F.filter("_inside", lambda r: r["_released"] <= day)
    out = df.withColumn("_month", month).join(starts, "_month", "left")
    return out.withColumn(name, F.coalesce(F.try_element_at(earlier, F.lit(-1))["version"], F.col("_before"))).drop(
        "_month", "_before", "_inside"
    )


def release_matrix(df: DataFrame, watched: Sequence[tuple[str, str | None]] = WATCHED, by: Sequence[str] = ()) -> DataFrame:
    """Share of each watched theme per version, on its platform or on all."""
    cube = df.select(
        *by, blank_to_null(F.col("app_version")).alias("version"), "primary_theme",
        optional(df, "platform").alias("_platform"),
    ).filter(F.col("version").isNotNull()).groupBy(*by, "version", "primary_theme", "_platform").agg(
        F.count("*").alias("rows")
    )
    specs = F.explode(F.array(*[
        F.struct(F.lit(t).alias("theme"), F.lit(p).cast("string").alias("platform")) for t, p in watched
    ]))
    everywhere = F.col("spec.platform").isNull() if "platform" in df.columns else F.lit(True)
    return (
        cube.select("*", specs.alias("spec")).filter(everywhere | (F.col("_platform") == F.col("spec.platform")))
        .groupBy(*by, F.col("spec.theme").alias("watched_theme"), F.col("spec.platform").alias("watched_platform"), "version")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum(F.when(F.col("primary_theme") == F.col("spec.theme"), F.col("rows")).otherwise(0)).alias("theme_rows"),
        )
        .withColumn("share", F.col("theme_rows") / F.col("rows"))
    )


def release_stories(df: DataFrame, watched: Sequence[tuple[str, str | None]] = WATCHED, by: Sequence[str] = (), *,
                    limit: int = 6) -> DataFrame:
    """Versions whose share of a watched theme stands out from the neighbouring versions, largest change first."""
    spec = [*by, "watched_theme", "watched_platform"]
    ordered = Window.partitionBy(*spec).orderBy(version_key(F.col("version")), "version")
    near = release_matrix(df, watched, by).withColumns({
        "before": F.lag("share").over(ordered), "after": F.lead("share").over(ordered),
    })
    neighbours = F.filter(F.array("before", "after"), lambda v: v.isNotNull())
    baseline = F.aggregate(neighbours, F.lit(0.0), lambda a, v: a + v) / F.size(neighbours)
    near = near.withColumn("_baseline", F.when(F.size(neighbours) > 0, baseline))
    change = F.col("share") - F.col("_baseline")
    told = near.withColumn("_change", change).filter((F.abs("_change") >= MIN_CHANGE) & (F.col("theme_rows") > 0))
    told = null_safe(told, _supporting_ids(df, watched, by), [*spec, "version"], "inner")
    direction = F.when(F.col("_change") > 0, "increase").otherwise("decrease")
    where = F.concat(F.coalesce(F.concat("watched_platform", F.lit(" ")), F.lit("")), F.lit("version "), F.col("version"))
    stories = told.select(
        *by,
        F.concat(F.lit("Observed "), "watched_theme", F.lit(" "), direction, F.lit(" in version "), "version").alias("title"),
        "version", "watched_platform",
        F.concat("watched_theme", F.lit(" share")).alias("metric_name"),
        safe_float(F.col("before")).alias("before_value"),
        safe_float(F.col("share")).alias("during_value"),
        safe_float(F.col("after")).alias("after_value"),
        direction.alias("direction"),
        safe_float(F.col("_change")).alias("magnitude"),
        "supporting_review_ids",
        F.concat(F.lit("Observed "), direction, F.lit(" in "), "watched_theme", F.lit(" feedback for "), where,
                 F.lit(" relative to adjacent versions.")).alias("evidence_note"),
    )
    size = F.desc(F.abs("magnitude"))
    per_spec = top_per_group(stories, [*by, "metric_name", "watched_platform"], [size, F.asc("version")], limit, "_rank")
    rank = F.row_number().over(window(by, size, F.asc("version"), F.asc("metric_name")))
    return per_spec.drop("_rank").withColumn("rank", rank).filter(F.col("rank") <= limit)


def _supporting_ids(df: DataFrame, watched: Sequence[tuple[str, str | None]], by: Sequence[str]) -> DataFrame:
    """The three smallest review ids per watched theme, platform and version."""
    specs = F.explode(F.array(*[
        F.struct(F.lit(t).alias("theme"), F.lit(p).cast("string").alias("platform")) for t, p in watched
    ]))
    everywhere = F.col("spec.platform").isNull() if "platform" in df.columns else F.lit(True)
    rows = df.filter(F.col("primary_theme").isin([t for t, _ in watched])).select(
        *by, blank_to_null(F.col("app_version")).alias("version"), "review_id", "primary_theme",
        optional(df, "platform").alias("_platform"), specs.alias("spec"),
    ).filter(
        F.col("version").isNotNull() & (F.col("primary_theme") == F.col("spec.theme"))
        & (everywhere | (F.col("_platform") == F.col("spec.platform")))
    ).select(*by, F.col("spec.theme").alias("watched_theme"), F.col("spec.platform").alias("watched_platform"), "version", "review_id")
    keys = [*by, "watched_theme", "watched_platform", "version"]
    ranked = top_per_group(rows, keys, [F.asc("review_id")], 3, "rank")
    return ranked.groupBy(*keys).agg(ids_in_rank_order("rank", "review_id").alias("supporting_review_ids"))
