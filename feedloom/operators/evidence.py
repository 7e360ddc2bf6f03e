"""Evidence contexts: the grounded summary of a table, or of each of its segments, as JSON within a size budget.

A context is kept as rows (section, position, item) until the end. That makes the budget a running sum over rows and
builds the contexts of any number of segments in one job; ``by`` names the segment columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.numbers import safe_float, safe_share, smoothed_growth, trend_direction
from feedloom.operators.filters import pain_only
from feedloom.operators.grouping import attach, null_safe, optional, top_per_group, window, with_group_value, with_lists, without_keys
from feedloom.operators.metrics import summarize_themes
from feedloom.operators.quality import quality_summary, required_columns
from feedloom.operators.quotes import id_lists, representative_ids, request_ids, unique_quote_evidence
from feedloom.operators.releases import WATCHED, release_stories
from feedloom.operators.segments import (
    DIMENSIONS,
    dataset_summary,
    rating_summary,
    segment_insights,
    sentiment_summary,
)
from feedloom.operators.trends import day_theme_volume, weekly_volume
from feedloom.session import materialize

SCHEMA_VERSION = "1.0"
REQUIRED = ("review_id", "original_text", "rating", "sentiment", "primary_theme")
PAIN_SECTIONS = {
    "top_pain_points": "frequency", "fastest_growing_issues": "growth_rate", "highest_priority_issues": "priority_score",
}
SEGMENT_SECTIONS = dict(zip(
    DIMENSIONS, ("platform_insights", "version_insights", "user_segment_insights", "subscription_tier_insights"), strict=True
))
LIST_SECTIONS = (
    *PAIN_SECTIONS, "top_feature_requests", *SEGMENT_SECTIONS.values(), "representative_quotes", "release_stories",
    "limitations",
)
# The order in which evidence is dropped from an oversized context, and how much always stays.
DROP_ORDER = (
    ("representative_quotes", 4), ("subscription_tier_insights", 2), ("user_segment_insights", 2),
    ("version_insights", 2), ("platform_insights", 2), ("top_feature_requests", 3), ("release_stories", 0),
    ("fastest_growing_issues", 3), ("highest_priority_issues", 3), ("top_pain_points", 3),
)
DEFAULT_BUDGET, PAIN_QUOTES, REQUEST_QUOTES = 24_000, 8, 5

# How the figures were made and what they cannot show; our own wording.
METHODOLOGY = {
    "sentiment_method": "Lexicon polarity with keyword overrides, blended with the star rating.",
    "pain_point_method": "Scored phrase and keyword rules, then similarity to the rule table.",
    "feature_request_method": "Request wording gates scored matches against request groups.",
    "prioritization_method": "Weighted frequency, severity, trend, business risk and confidence.",
    "trend_method": "Bounded growth of the last 14 days over the 14 days before.",
    "quote_selection_method": "Exact source rows in a fixed ranking.",
    "confidence_note": "Confidence is match strength, not a probability.",
}
LIMITATIONS = (
    "Lexicon sentiment can miss sarcasm and other languages.",
    "Rules can miss unfamiliar wording.",
    "Confidence is match strength, not a probability.",
    "Growth is unstable for rare categories.",
    "Release patterns are correlations, not causes.",
    "Quotes are examples, not all evidence.",
)
NO_TIER_LIMITATION = "The table has no subscription tier."


def compact_json(*columns: Column | str) -> Column:
    """JSON object with every field, nulls included, in the given order."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def sorted_json(df: DataFrame, names: Sequence[str]) -> Column:
    return compact_json(*[F.col(n) for n in sorted(names)])


def theme_context(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per theme: all affected platforms and versions, sorted, and the representative ids."""
    keys = [*by, "theme"]
    names = {"affected_platforms": "platform", "affected_versions": "app_version"}
    rows = df.filter(F.col("primary_theme").isNotNull()).withColumn("theme", F.col("primary_theme"))
    ids = id_lists(representative_ids(df, by), keys)  # one row for every theme
    return with_lists(ids, rows, keys, {name: F.col(c) if c in df.columns else None for name, c in names.items()}).select(
        *keys, *names, "representative_review_ids"
    )


PAIN_FIELDS = (
    "rank", "theme", "review_count", "negative_review_count", "share_of_reviews", "average_rating", "severity_score",
    "priority_score", "business_risk", "trend_direction", "growth_rate", "affected_platforms", "affected_versions",
    "representative_review_ids",
)


def pain_rankings(summary: DataFrame, by: Sequence[str] = (), *, limit: int = 8) -> DataFrame:
    """Top pain themes by frequency, growth and priority: one row per section and rank."""
    ranks = {
        section: F.row_number().over(window(by, F.desc(F.coalesce(F.col(metric), F.lit(0))), F.desc("frequency"), F.asc("theme")))
        for section, metric in PAIN_SECTIONS.items()
    }
    ranked = pain_only(summary).withColumns({f"_{section}": rank for section, rank in ranks.items()})
    sections = F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), F.col(f"_{section}").alias("rank")) for section in ranks
    ]))
    rows = ranked.select("*", sections.alias("_place")).select("*", "_place.*").filter(F.col("rank") <= limit)
    return rows.drop("_place", *[f"_{section}" for section in ranks])


def pain_records(df: DataFrame, summary: DataFrame, by: Sequence[str] = (), *, limit: int = 8) -> DataFrame:
    """The fourteen-field pain record of every ranked theme."""
    ranked = null_safe(pain_rankings(summary, by, limit=limit), theme_context(df, by), [*by, "theme"])
    growth = safe_float(F.col("growth_rate"))
    return ranked.select(
        *by, "section", "rank", "theme", F.col("frequency").alias("review_count"),
        F.col("negative_count").alias("negative_review_count"),
        safe_share(F.col("frequency"), F.col("total_rows")).alias("share_of_reviews"),
        *[safe_float(F.col(c)).alias(c) for c in ("average_rating", "severity_score", "priority_score")],
        "business_risk", trend_direction(growth).alias("trend_direction"), growth.alias("growth_rate"),
        "affected_platforms", "affected_versions", "representative_review_ids",
    )


def request_growth(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Growth per request group on raw timestamps, with no coverage guard.

    The previous window ends one day before the recent one starts, so with times of day the rows in between count in
    neither window.
    """
    dated = with_group_value(df, df, by, "_end", F.max("date"))
    day = "interval {} days".format
    recent_start = F.col("_end") - F.expr(day(13))
    previous_start = F.col("_end") - F.expr(day(27))
    date = F.col("date")
    groups = dated.filter(F.col("is_feature_request") & F.col("feature_request_group").isNotNull()).groupBy(
        *by, "feature_request_group"
    ).agg(
        F.count_if(date.between(recent_start, F.col("_end"))).alias("recent_count"),
        F.count_if(date.between(previous_start, recent_start - F.expr(day(1)))).alias("previous_count"),
        F.max("_end").alias("_end"),
    )
    growth = F.bround(smoothed_growth(F.col("recent_count"), F.col("previous_count")), 4)
    return groups.withColumn("growth_rate", F.when(F.col("_end").isNotNull(), growth)).drop("_end")


REQUEST_FIELDS = (
    "rank", "group", "request_count", "share_of_requests", "average_confidence", "trend_direction", "growth_rate",
    "affected_platforms", "affected_segments", "representative_review_ids",
)


def request_insights(df: DataFrame, by: Sequence[str] = (), *, limit: int = 8) -> DataFrame:
    """Leading request groups with share of requests, confidence, growth, reach and example ids."""
    requests = df.filter(F.col("is_feature_request") & F.col("feature_request_group").isNotNull())
    keys = [*by, "feature_request_group"]
    names = {"affected_platforms": "platform", "affected_segments": "user_segment"}
    groups = requests.groupBy(*keys).agg(
        F.count("*").alias("request_count"),
        safe_float(F.avg(optional(df, "feature_request_confidence", data_type="double"))).alias("average_confidence"),
    ).withColumn("_all", F.sum("request_count").over(window(by)))
    groups = with_lists(groups, requests, keys, {name: F.col(c) if c in df.columns else None for name, c in names.items()})
    if "date" in df.columns:
        groups = null_safe(groups, request_growth(df, by).select(*keys, "growth_rate"), keys)
    else:
        groups = groups.withColumn("growth_rate", F.lit(None).cast("double"))
    groups = null_safe(groups, id_lists(request_ids(df, by), keys), keys)
    order = [
        F.desc("request_count"), F.desc(F.coalesce("average_confidence", F.lit(0.0))), F.asc("feature_request_group"),
    ]
    return top_per_group(groups, by, order, limit, "rank").select(
        *by, "rank", F.col("feature_request_group").alias("group"), "request_count",
        safe_share(F.col("request_count"), F.col("_all")).alias("share_of_requests"), "average_confidence",
        trend_direction(F.col("growth_rate")).alias("trend_direction"), "growth_rate", "affected_platforms",
        "affected_segments", "representative_review_ids",
    )


def quote_groups(pain: DataFrame, requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Evidence groups in quote order: the leading pain themes, then the leading request groups."""
    themes = pain.filter((F.col("section") == "top_pain_points") & (F.col("rank") <= PAIN_QUOTES))
    leading = requests.filter(F.col("rank") <= REQUEST_QUOTES)
    return themes.select(*by, F.lit("pain_point").alias("kind"), F.col("theme").alias("key"), F.col("rank").alias("position")).unionByName(
        leading.select(*by, F.lit("feature_request").alias("kind"), F.col("group").alias("key"),
                       (F.col("rank") + PAIN_QUOTES).alias("position"))
    )


STORY_FIELDS = (
    "title", "version", "platform", "period_start", "period_end", "metric_name", "before_value", "during_value",
    "after_value", "direction", "magnitude", "supporting_review_ids", "evidence_note",
)


def context_rows(df: DataFrame, by: Sequence[str] = (), *, raw_rows: int | None = None, report: DataFrame | None = None,
                 generated_at: str | None = None, max_pain_points: int = 8, max_requests: int = 8, max_quotes: int = 16,
                 max_segment_values: int = 6, max_stories: int = 6,
                 watched: Sequence[tuple[str, str | None]] = WATCHED) -> DataFrame:
    """Every piece of evidence as a row: ``by``, section, position (from 1; 0 for single objects), item as JSON.

    Reads ``df`` about a dozen times: pass a stored table. The rows themselves are few and are stored.
    """
    required_columns(df, (*REQUIRED, *by))
    summary = summarize_themes(df, by)
    pain = materialize(pain_records(df, summary, by, limit=max_pain_points))
    has_requests = {"is_feature_request", "feature_request_group"} <= set(df.columns)
    parts: list[DataFrame] = [_items(pain, by, F.col("section"), F.col("rank"), sorted_json(pain, PAIN_FIELDS))]
    segments = df.select(*by).distinct() if by else df.sparkSession.range(1).select()

    if has_requests:
        requests = materialize(request_insights(df, by, limit=max_requests))
        parts.append(_items(requests, by, F.lit("top_feature_requests"), F.col("rank"), sorted_json(requests, REQUEST_FIELDS)))
        groups = quote_groups(pain, requests, by)
    else:
        groups = quote_groups(pain, pain.select(*by, F.col("theme").alias("group"), "rank").limit(0), by)
    quotes = unique_quote_evidence(df, groups, by, limit=max_quotes)
    quote_fields = sorted(quotes.schema["quote"].dataType.names)
    parts.append(_items(quotes, by, F.lit("representative_quotes"), F.col("rank"),
                        compact_json(*[F.col(f"quote.{f}") for f in quote_fields])))

    dimensions = [d for d in DIMENSIONS if d in df.columns]
    if dimensions:
        values = segment_insights(df, dimensions, by, limit=max_segment_values)
        names = [c for c in values.columns if c not in (*by, "rank")]
        section = F.col("dimension")
        for d, name in SEGMENT_SECTIONS.items():
            section = F.when(F.col("dimension") == d, name).otherwise(section)
        parts.append(_items(values, by, section, F.col("rank"), sorted_json(values, names)))
    if "app_version" in df.columns:
        stories = release_stories(df, watched, by, limit=max_stories).withColumns({
            "period_start": F.lit(None).cast("string"), "period_end": F.lit(None).cast("string"),
        })
        story = compact_json(*[F.col("watched_platform").alias(f) if f == "platform" else F.col(f) for f in sorted(STORY_FIELDS)])
        parts.append(_items(stories, by, F.lit("release_stories"), F.col("rank"), story))

    for name, frame in (
        ("dataset", dataset_summary(df, by, raw_rows=raw_rows)),
        ("sentiment", sentiment_summary(df, by)),
        ("ratings", rating_summary(df, by)),
        ("context_statistics", _statistics(df, pain, by)),
    ):
        names = [c for c in frame.columns if c not in by]
        parts.append(_items(frame, by, F.lit(name), F.lit(0), sorted_json(frame, names)))

    quality = quality_summary(report, df.sparkSession)
    quality = quality.select(sorted_json(quality, quality.columns).alias("item"))
    stamp = generated_at or datetime.now(UTC).replace(microsecond=0).isoformat()
    notes = (*LIMITATIONS, *(() if "subscription_tier" in df.columns else (NO_TIER_LIMITATION,)))
    fixed = [
        ("schema_version", 0, F.to_json(F.array(F.lit(SCHEMA_VERSION)))),
        ("generated_at_utc", 0, F.to_json(F.array(F.lit(stamp)))),
        ("methodology", 0, compact_json(*[F.lit(v).alias(k) for k, v in sorted(METHODOLOGY.items())])),
        *(("limitations", i, F.to_json(F.array(F.lit(n)))) for i, n in enumerate(notes, start=1)),
        *((name, None, F.lit(None).cast("string")) for name in LIST_SECTIONS),
    ]
    # A one-element array around a string gives its JSON form; the brackets come off.
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(s).alias("section"), F.lit(p).cast("int").alias("position"),
            F.regexp_replace(item, r"^\[|\]$", "").alias("item") if s in ("schema_version", "generated_at_utc", "limitations") else item.alias("item"),
        ) for s, p, item in fixed
    ]))
    parts.append(segments.select(*by, rows.alias("r")).select(*by, "r.*"))
    parts.append(attach(segments, quality, ()).select(*by, F.lit("data_quality").alias("section"), F.lit(0).alias("position"), "item"))
    return materialize(reduce(DataFrame.unionByName, parts))


def _items(frame: DataFrame, by: Sequence[str], section: Column, position: Column, item: Column) -> DataFrame:
    return frame.select(*by, section.alias("section"), position.cast("int").alias("position"), item.alias("item"))


def _statistics(df: DataFrame, pain: DataFrame, by: Sequence[str]) -> DataFrame:
    flag = F.coalesce(optional(df, "is_feature_request", False, "boolean"), F.lit(False))
    counts = df.groupBy(*by).agg(
        F.count("*").alias("cleaned_reviews"), F.count_if(flag).alias("detected_feature_requests")
    )
    themes = pain.filter(F.col("section") == "top_pain_points").groupBy(*by).agg(F.count("*").alias("detected_pain_themes"))
    out = attach(counts, themes, by)
    if "date" in df.columns:
        weeks = weekly_volume(day_theme_volume(df, by), by).groupBy(*by).agg(F.count("*").alias("weekly_periods"))
        out = attach(out, weeks, by)
    else:
        out = out.withColumn("weekly_periods", F.lit(0).cast("long"))
    return out.na.fill(0, ["detected_pain_themes", "weekly_periods"])


def assemble(rows: DataFrame, by: Sequence[str] = (), *, skip: Sequence[str] = ()) -> DataFrame:
    """One JSON document per segment: sections in name order, list items in position order."""
    items = F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("position", "item"))))
    body = F.array_join(F.transform(items, lambda i: i["item"]), ",")
    sections = rows.filter(~F.col("section").isin(*skip) if skip else F.lit(True)).groupBy(*by, "section").agg(body.alias("_body"))
    text = F.when(F.col("section").isin(*LIST_SECTIONS), F.concat(F.lit("["), "_body", F.lit("]"))).otherwise(F.col("_body"))
    field = F.concat(F.lit('"'), "section", F.lit('":'), text)
    whole = F.array_sort(F.collect_list(F.struct("section", field.alias("field"))))
    joined = F.array_join(F.transform(whole, lambda f: f["field"]), ",")
    return sections.groupBy(*by).agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("context_json"))


def build_insight_context(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """One row per segment: the full context as deterministic JSON."""
    return assemble(context_rows(df, by, **options), by)


def compact_rows(rows: DataFrame, by: Sequence[str] = (), *, max_characters: int = DEFAULT_BUDGET) -> DataFrame:
    """Drop optional evidence in the fixed order until each context fits; adds ``fits`` and ``truncated``.

    An item goes if the context is still too long with everything before it in the drop order already gone.
    """
    if max_characters <= 0:
        raise ValueError("max_characters must be positive.")
    sized = attach(rows, assemble(rows, by).select(*by, F.length("context_json").alias("_length")), by)
    phase, keep = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (section, kept) in enumerate(DROP_ORDER):
        phase = F.when(F.col("section") == section, i).otherwise(phase)
        keep = F.when(F.col("section") == section, kept).otherwise(keep)
    sized = sized.withColumns({"_phase": phase, "_keep": keep})
    droppable = F.col("_phase").isNotNull() & (F.col("position") > F.col("_keep"))
    # The comma goes with the item, except for the last item of a list.
    freed = F.when(droppable, F.length("item") + F.when(F.col("position") > 1, 1).otherwise(0)).otherwise(0)
    sized = sized.withColumn("_freed", freed)
    earlier = window(by, F.asc_nulls_last("_phase"), F.desc("position"))
    before = F.coalesce(F.sum("_freed").over(earlier.rowsBetween(_ALL_BEFORE, -1)), F.lit(0))
    sized = sized.withColumns({"_before": before, "_all": F.sum("_freed").over(window(by))})
    dropped = (F.col("_freed") > 0) & (F.col("_length") - F.col("_before") > max_characters)
    return sized.filter(~dropped).select(
        *by, "section", "position", "item",
        (F.col("_length") - F.col("_all") <= max_characters).alias("fits"),
        (F.col("_length") > max_characters).alias("truncated"),
    )


_ALL_BEFORE = -(2**31)


def compact_insight_context(rows: DataFrame, by: Sequence[str] = (), *, max_characters: int = DEFAULT_BUDGET) -> DataFrame:
    """The compact context of every segment with its size figures. ``fits`` is false where even the mandatory part
    is too long."""
    kept = compact_rows(rows, by, max_characters=max_characters)

    def n(section: str) -> Column:
        return F.count_if((F.col("section") == section) & F.col("item").isNotNull())

    counts = kept.groupBy(*by).agg(
        n("representative_quotes").alias("quote_count"), n("top_pain_points").alias("pain_point_count"),
        n("top_feature_requests").alias("feature_request_count"),
        F.bool_and("fits").alias("fits"), F.bool_or("truncated").alias("truncation_applied"),
    )
    out = attach(assemble(kept, by), counts, by)
    size = F.length("context_json")
    return attach(out, fingerprints(kept, by), by).select(
        *by, "context_json", size.alias("character_count"), F.ceil(size / 4).alias("approximate_token_count"),
        "quote_count", "pain_point_count", "feature_request_count", "truncation_applied", "fits", "context_fingerprint",
    )


def fingerprints(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stable hash of each context without its generation time."""
    stable = assemble(rows, by, skip=("generated_at_utc",))
    return stable.select(*by, F.sha2(F.encode("context_json", "utf-8"), 256).alias("context_fingerprint"))


def stale_segments(current: DataFrame, stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Segments whose fingerprint differs from the stored one, or that have none."""
    return without_keys(current.select(*by, "context_fingerprint"), stored, [*by, "context_fingerprint"])
