"""Dataset, sentiment and rating summaries, segment comparisons and value distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.dates import iso_date
from feedloom.functions.numbers import in_rating_range, safe_float, safe_share
from feedloom.functions.text import blank_to_null, nonblank
from feedloom.operators.grouping import optional, top_per_group, window
from feedloom.vocab.themes import NON_PAIN_THEMES

DIMENSIONS = ("platform", "app_version", "user_segment", "subscription_tier")
SENTIMENTS = ("Negative", "Neutral", "Positive")


def dataset_summary(df: DataFrame, by: Sequence[str] = (), *, raw_rows: int | None = None,
                    approximate_distinct: bool = False) -> DataFrame:
    """Rows, dates and the number of different values. Rows collapse to one per combination of values first, so that the
    distinct counts run over few rows."""
    counted = F.approx_count_distinct if approximate_distinct else F.count_distinct
    names = {
        "platforms": "platform", "versions": "app_version", "countries": "country", "user_segments": "user_segment",
        "subscription_tiers": "subscription_tier",
    }
    date = optional(df, "date", data_type="timestamp_ntz")
    present = {f"_{name}": blank_to_null(F.col(c)) for name, c in names.items() if c in df.columns}
    cube = df.select(*by, *[value.alias(name) for name, value in present.items()], date.alias("_date")).groupBy(*by, *present).agg(
        F.count("*").alias("_rows"), F.min("_date").alias("_first"), F.max("_date").alias("_last")
    )
    first, last = F.min("_first"), F.max("_last")
    return cube.groupBy(*by).agg(
        F.lit(raw_rows).cast("long").alias("total_raw_reviews"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_cleaned_reviews"),
        iso_date(first).alias("date_start"),
        iso_date(last).alias("date_end"),
        # Whole days between the raw timestamps, as the summary reports them.
        (F.floor((F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / F.lit(86_400_000_000)) + 1).alias("total_days"),
        *[(counted(f"_{name}") if f"_{name}" in present else F.lit(0).cast("long")).alias(name) for name in names],
    )


def sentiment_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    def n(label: str) -> Column:
        return F.count_if(F.col("sentiment") == label)

    return df.groupBy(*by).agg(
        *[n(s).alias(f"{s.lower()}_count") for s in SENTIMENTS],
        *[safe_share(n(s), F.count("*")).alias(f"{s.lower()}_share") for s in SENTIMENTS],
        safe_float(F.avg(optional(df, "sentiment_score", data_type="double"))).alias("average_sentiment_score"),
    )


def rating_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, exact median, star counts and low/high shares of the ratings within 1..5.

    All of them come from the counts per group and value. The median is where their running total passes half of all: of
    the two middle rows one may be the last of a value and the other the first of the next. No group's values meet in memory.
    """
    rating = F.col("rating").cast("double")
    valid = F.when(in_rating_range(rating), rating)
    counts = df.groupBy(*by, valid.alias("_value")).agg(F.count("*").alias("_n")).withColumn("_n", F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(0))
    upto = F.sum("_n").over(window(by, F.asc("_value")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(window(by))})
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    value, n = F.col("_value"), F.col("_n")
    stars = F.bround(value, 0)
    names = ("one", "two", "three", "four", "five")

    def at(place: Column) -> Column:
        return F.min(F.when((F.col("_upto") >= place) & (n > 0), value))

    def rows(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, n).otherwise(0)), F.lit(0))

    return placed.groupBy(*by).agg(
        safe_float(F.sum(value * n) / F.nullif(F.sum(n), F.lit(0))).alias("average_rating"),
        safe_float((at(lower) + at(upper)) / 2).alias("median_rating"),
        *[rows(stars == i).alias(f"{name}_star_count") for i, name in enumerate(names, start=1)],
        safe_share(rows(value.isin(1.0, 2.0)), F.sum(n)).alias("low_rating_share"),
        safe_share(rows(value.isin(4.0, 5.0)), F.sum(n)).alias("high_rating_share"),
    )


def segment_cube(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS, by: Sequence[str] = ()) -> DataFrame:
    """Additive measures per dimension value, theme and request group, for all dimensions in one pass."""
    present = [d for d in dimensions if d in df.columns]
    flag = F.coalesce(optional(df, "is_feature_request", False, "boolean"), F.lit(False))
    cells = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.when(nonblank(F.col(d)), F.col(d).cast("string")).alias("value"))
        for d in present
    ]))
    return df.select(
        *by, cells.alias("cell"), "primary_theme", "sentiment", F.col("rating").cast("double").alias("rating"),
        F.when(flag, optional(df, "feature_request_group")).alias("request_group"),
    ).filter(F.col("cell.value").isNotNull()).groupBy(
        *by, F.col("cell.dimension").alias("dimension"), F.col("cell.value").alias("value"), "primary_theme", "request_group"
    ).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("sentiment") == "Negative").alias("negative_rows"),
        F.count_if(F.col("sentiment") == "Positive").alias("positive_rows"),
        F.sum("rating").alias("rating_sum"), F.count("rating").alias("rating_rows"),
    )


def mode_by_count(counts: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent value per key from pre-counted rows, ties to the smaller value."""
    totals = counts.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum("rows").alias("rows"))
    best = top_per_group(totals, keys, [F.desc("rows"), F.asc(value)], 1, "_rank")
    return best.select(*keys, F.col(value).alias(name))


def segment_insights(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS, by: Sequence[str] = (), *,
                     limit: int = 6) -> DataFrame:
    """The largest ``limit`` values of every dimension with shares, mean rating, top pain theme and top request."""
    return insights_of_cube(segment_cube(df, dimensions, by), by, limit=limit)


def insights_of_cube(cube: DataFrame, by: Sequence[str] = (), *, limit: int = 6) -> DataFrame:
    """Segment insights of a segment cube; its rows may repeat keys, as those of several batches do."""
    keys = [*by, "dimension", "value"]
    # One chain over the cube, so that what the cube is made of is computed once.
    cube = cube.withColumns({
        "_theme_rows": F.sum("rows").over(window([*keys, "primary_theme"])), "_request_rows": F.sum("rows").over(window([*keys, "request_group"])),
    })
    pain = F.col("primary_theme").isNotNull() & ~F.col("primary_theme").isin(*NON_PAIN_THEMES)

    def leading(condition: Column, count: str, value: str) -> Column:
        return F.min(F.when(condition, F.struct((-F.col(count)).alias("count"), F.col(value).alias("value"))))["value"]

    values = cube.groupBy(*keys).agg(
        F.sum("rows").alias("review_count"),
        safe_share(F.sum("negative_rows"), F.sum("rows")).alias("negative_share"),
        safe_share(F.sum("positive_rows"), F.sum("rows")).alias("positive_share"),
        safe_float(F.sum("rating_sum") / F.sum("rating_rows")).alias("average_rating"),
        leading(pain, "_theme_rows", "primary_theme").alias("top_pain_point"),
        leading(F.col("request_group").isNotNull(), "_request_rows", "request_group").alias("top_feature_request"),
    )
    return top_per_group(values, [*by, "dimension"], [F.desc("review_count"), F.asc("value")], limit, "rank")


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """Counts of the three sentiments, zeros included, with the share of all rows."""
    counts = df.agg(F.count("*").alias("_all"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("sentiment"), F.col(s).alias("count")) for s in SENTIMENTS]))
    return counts.select("_all", rows.alias("r")).select(
        "r.*", (F.col("r.count") * 100.0 / F.greatest("_all", F.lit(1))).alias("percentage")
    )


def rating_distribution(df: DataFrame) -> DataFrame:
    """Counts of the five stars (half-even rounded ratings), zeros included, with the share of rated rows."""
    stars = F.bround(F.col("rating"), 0)
    counts = df.agg(
        F.count("rating").alias("_all"), *[F.count_if(stars == i).alias(f"_{i}") for i in range(1, 6)]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("rating"), F.col(f"_{i}").alias("count")) for i in range(1, 6)]))
    return counts.select("_all", rows.alias("r")).select(
        "r.*", (F.col("r.count") * 100.0 / F.greatest("_all", F.lit(1))).alias("percentage")
    )


def top_themes(df: DataFrame, limit: int = 10) -> DataFrame:
    """Most mentioned themes apart from Other, with their share of all rows; ties to the smaller name."""
    counts = df.groupBy(F.col("primary_theme").alias("theme")).agg(F.count("*").alias("mentions"))
    return (
        counts.withColumn("share", F.col("mentions") * 100.0 / F.sum("mentions").over(window(())))
        .filter(F.col("theme").isNotNull() & (F.col("theme") != "Other"))
        .orderBy(F.desc("mentions"), F.asc("theme")).limit(limit)
    )


def theme_segment_crosstab(df: DataFrame, segment: str) -> DataFrame:
    """Rows per theme and segment value, zero-filled, in long form."""
    counts = df.filter(F.col(segment).isNotNull() & F.col("primary_theme").isNotNull()).groupBy(
        F.col("primary_theme").alias("theme"), F.col(segment).alias("segment")
    ).agg(F.count("*").alias("mentions"))
    # Zero-fill by exploding the list of themes, which is short, for every segment value.
    themes = counts.select(F.array_sort(F.collect_set("theme"))).scalar()
    grid = counts.select("segment").distinct().select("segment", F.explode(themes).alias("theme"))
    return grid.join(counts, ["theme", "segment"], "left").na.fill(0, ["mentions"])


def theme_segment_matrix(df: DataFrame, segment: str, values: Sequence[str] | None = None) -> DataFrame:
    """The same counts as a matrix, one column per segment value."""
    known = df.filter(F.col(segment).isNotNull() & F.col("primary_theme").isNotNull())
    grouped = known.groupBy(F.col("primary_theme").alias("theme"))
    pivoted = grouped.pivot(segment, list(values)) if values else grouped.pivot(segment)
    return pivoted.agg(F.count(F.lit(1))).na.fill(0)


def counts_by(df: DataFrame, *columns: str, name: str = "feedback") -> DataFrame:
    """Rows per combination of non-null values."""
    known = df
    for c in columns:
        known = known.filter(F.col(c).isNotNull())
    return known.groupBy(*columns).agg(F.count("*").alias(name))


def negatives_by(df: DataFrame, column: str) -> DataFrame:
    return counts_by(df.filter(F.col("sentiment") == "Negative"), column, name="complaints")


def mean_rating_by(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.avg("rating").alias("average_rating"))


def requests_by(df: DataFrame, column: str) -> DataFrame:
    return counts_by(df.filter("is_feature_request"), column, name="requests")


def top_values_per_theme(df: DataFrame, dimensions: Sequence[str], limit: int = 5) -> DataFrame:
    """The most frequent values of each dimension within each theme."""
    cube = segment_cube(df, dimensions).groupBy("primary_theme", "dimension", "value").agg(F.sum("rows").alias("rows"))
    order = [F.desc("rows"), F.asc("value")]
    return top_per_group(cube, ["primary_theme", "dimension"], order, limit, "rank")
