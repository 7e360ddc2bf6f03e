"""Queries of whole evidence contexts and of the plans: every leaf of a context against SQL, raw rows to aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.enrichment_sql import ANALYZED_CTES
from catalog.fixture import FEEDBACK_CTES, raw_feedback, sql_rows
from catalog.queries import (
    IDS_SQL,
    NOT_PAIN,
    NUMBERED_CTES,
    QUOTES_SQL,
    RANK_SQL,
    STAMP,
    SUMMARY_COLUMNS,
    SUMMARY_CTES,
    SUMMARY_DOUBLES,
    stored,
)
from catalog.registry import ORACLE, query
from feedloom.operators import evidence
from feedloom.operators.grounding import json_leaves, validate_reports
from feedloom.operators.quotes import quotes_by_theme, representative_quotes
from feedloom.operators.releases import WATCHED
from feedloom.operators.segments import DIMENSIONS
from feedloom.plans import analyze_feedback, prepare_insight
from feedloom.plans.ingest import ingest
from feedloom.session import materialize


def _leaves(contexts: DataFrame, key: str) -> DataFrame:
    """Path with number or text of every leaf: numbers are compared as numbers, whatever digits their JSON has."""
    leaves = json_leaves(contexts, key, "context_json")
    number = F.col("value").try_cast("double")
    return leaves.select(key, "path", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


def _sql_leaves(source: str, path: str, scalars: Sequence[str] = (), lists: Sequence[str] = (), key: str = "NULL") -> str:
    """The leaves of a relation's rows, each row being the object at ``path``; names may be given as ``name=expression``."""
    def split(item: str) -> tuple[str, str]:
        name, _, expression = item.partition("=")
        return name, expression or f'"{name}"'

    fields = ", ".join(f"{{'name': '{n}', 'value': CAST({e} AS VARCHAR)}}" for n, e in map(split, scalars))
    parts = [f"SELECT key, path || f.name AS path, f.value AS value FROM (SELECT {key} AS key, {path} AS path, unnest([{fields}]) AS f FROM {source})"]
    parts += [
        f"SELECT {key} AS key, {path} || '{n}[' || (generate_subscripts({e}, 1) - 1) || ']' AS path, unnest({e}) AS value FROM {source}"
        for n, e in map(split, lists)
    ]
    return " UNION ALL ".join(f"({p})" for p in parts)


def _split(column: str) -> str:
    return f"string_split({column}, '|')"


NUMBERS_OR_TEXT = """try_cast(value AS DOUBLE) AS number, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END AS text"""
_SECTION = "CASE dimension " + " ".join(f"WHEN '{d}' THEN '{evidence.SEGMENT_SECTIONS[d]}'" for d in DIMENSIONS) + " END"
_FIXED = [
    ("schema_version", evidence.SCHEMA_VERSION), ("generated_at_utc", STAMP), ("data_quality.notes[0]", "Cleaning report was not supplied."),
    *((f"methodology.{name}", text) for name, text in evidence.METHODOLOGY.items()),
    *((f"limitations[{i}]", text) for i, text in enumerate(evidence.LIMITATIONS)),
]
_SHARES = ("negative_share", "neutral_share", "positive_share")

CONTEXT_CTES = "RECURSIVE " + SUMMARY_CTES + f""", ranked AS ({RANK_SQL}), ids AS ({IDS_SQL}),
pains AS (SELECT p.*, s.severity_score, s.priority_score FROM ({ORACLE['pain_records']}) p JOIN summary s USING (theme)),
request_ranks AS (SELECT i.*, (SELECT string_agg(r.review_id, '|' ORDER BY r.rank) FROM ({ORACLE['request_ids']}) r WHERE r.feature_request_group = i."group") AS ids FROM ({ORACLE['request_insights']}) i),
segs AS ({ORACLE['segment_insights']}),
stories AS (SELECT *, row_number() OVER (ORDER BY abs(magnitude) DESC, version, metric_name) AS place, left(metric_name, length(metric_name) - 6) AS watched FROM ({ORACLE['release_stories']})),
quoted AS ({ORACLE['unique_quote_evidence']}),
dataset AS ({ORACLE['dataset_summary']}), sentiment AS ({ORACLE['sentiment_summary']}), ratings AS ({ORACLE['rating_summary']}),
statistics AS (SELECT count(*) AS cleaned_reviews, count(*) FILTER (is_feature_request) AS detected_feature_requests,
  (SELECT count(*) FROM ranked WHERE section = 'top_pain_points') AS detected_pain_themes, (SELECT count(*) FROM ({ORACLE['weekly_volume']})) AS weekly_periods FROM analyzed),
leaves AS (""" + " UNION ALL ".join([
    _sql_leaves("pains", "section || '[' || (rank - 1) || '].'", (
        "rank", "theme", "review_count", "negative_review_count", "share_of_reviews", "average_rating", "severity_score=round_even(severity_score, 4)",
        "priority_score=round_even(priority_score, 4)", "business_risk", "trend_direction", "growth_rate",
    ), [f"affected_platforms={_split('platforms')}", f"affected_versions={_split('versions')}", f"representative_review_ids={_split('ids')}"]),
    _sql_leaves("request_ranks", "'top_feature_requests[' || (rank - 1) || '].'", (
        "rank", "group", "request_count", "share_of_requests", "average_confidence", "trend_direction", "growth_rate",
    ), [f"affected_platforms={_split('platforms')}", f"affected_segments={_split('user_segments')}", f"representative_review_ids={_split('ids')}"]),
    _sql_leaves("segs", _SECTION + " || '[' || (rank - 1) || '].'", (
        "dimension", "value", "review_count", "negative_share", "positive_share", "average_rating", "top_pain_point", "top_feature_request",
    )),
    _sql_leaves("(SELECT * FROM stories WHERE place <= 6)", "'release_stories[' || (place - 1) || '].'", (
        "title", "version", "platform", "metric_name", "before_value", "during_value", "after_value", "direction", "magnitude",
        "evidence_note='Observed ' || direction || ' in ' || watched || ' feedback for ' || coalesce(platform || ' ', '') || 'version ' || version || ' relative to adjacent versions.'",
    ), [f"supporting_review_ids={_split('ids')}"]),
    _sql_leaves("quoted", "'representative_quotes[' || (rank - 1) || '].'", (
        "review_id", "review_text", "rating=round_even(rating, 4)", "date", "platform", "app_version", "sentiment_label", "pain_point_theme",
        "feature_request_group", "evidence_type", "source_row_index",
    )),
    _sql_leaves("dataset", "'dataset.'", (
        "total_raw_reviews", "total_cleaned_reviews", "date_start", "date_end", "total_days", "platforms", "versions", "countries", "user_segments", "subscription_tiers",
    )),
    _sql_leaves("sentiment", "'sentiment.'", ("negative_count", "neutral_count", "positive_count", *_SHARES, "average_sentiment_score")),
    _sql_leaves("ratings", "'ratings.'", (
        "average_rating", "median_rating", "one_star_count", "two_star_count", "three_star_count", "four_star_count", "five_star_count", "low_rating_share", "high_rating_share",
    )),
    _sql_leaves("statistics", "'context_statistics.'", ("cleaned_reviews", "detected_feature_requests", "detected_pain_themes", "weekly_periods")),
    f"SELECT NULL AS key, path, value FROM {sql_rows(_FIXED)} v(path, value)",
]) + ")"


@query("context_leaves", CONTEXT_CTES, f"SELECT path, {NUMBERS_OR_TEXT} FROM leaves WHERE value IS NOT NULL", "number")
def _(spark, sf_dir):
    """Every leaf of the full evidence context of all rows."""
    whole = evidence.build_insight_context(stored(spark, sf_dir), generated_at=STAMP, watched=WATCHED)
    return _leaves(whole.withColumn("report", F.lit("all")), "report").drop("report")


@query("context_budget", CONTEXT_CTES, """SELECT step AS max_characters, section, least(n, CASE WHEN step > 100000 THEN n ELSE kept END) AS items FROM (
  SELECT section, count(DISTINCT item) AS n FROM (SELECT regexp_extract(path, '^[a-z_]+') AS section, regexp_extract(path, '\\[\\d+\\]') AS item FROM leaves WHERE value IS NOT NULL) WHERE item <> '' GROUP BY 1)
  JOIN (SELECT * FROM """ + sql_rows(evidence.DROP_ORDER) + """ v(section, kept)) USING (section), (VALUES (1), (1000000)) s(step)
  WHERE least(n, CASE WHEN step > 100000 THEN n ELSE kept END) > 0""")
def _(spark, sf_dir):
    """Items that stay per droppable list: all of them below a large budget, only the least ones below an impossible one."""
    rows = evidence.context_rows(stored(spark, sf_dir), generated_at=STAMP)
    kept = [
        evidence.compact_rows(rows, max_characters=size).filter(F.col("item").isNotNull() & F.col("section").isin([s for s, _ in evidence.DROP_ORDER]))
        .groupBy("section").agg(F.count("*").cast("int").alias("items")).withColumn("max_characters", F.lit(size)) for size in (1, 1_000_000)
    ]
    return kept[0].unionByName(kept[1])


SELECTED = ("Negative", "Neutral")
_PLATFORM_PAIN = f"""SELECT platform, primary_theme AS theme, count(*) AS review_count, count(*) FILTER (sentiment = 'Negative') AS negative_review_count,
  round_even(count(*) / any_value(n), 4) AS share_of_reviews, round_even(avg(rating), 4) AS average_rating,
  row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, primary_theme) AS rank
  FROM (SELECT *, count(*) OVER (PARTITION BY platform) AS n FROM picked) WHERE primary_theme NOT IN {NOT_PAIN} GROUP BY platform, primary_theme"""
_MONDAY = "CAST(date AS DATE) + CAST((8 - isodow(CAST(date AS DATE))) % 7 AS INT)"

PLATFORM_CTES = ANALYZED_CTES + f""",
picked AS (SELECT * FROM analyzed WHERE sentiment IN {SELECTED}),
pains AS (SELECT * FROM ({_PLATFORM_PAIN}) WHERE rank <= 8),
sums AS (SELECT platform, count(*) AS total_cleaned_reviews, strftime(min(date), '%Y-%m-%d') AS date_start, strftime(max(date), '%Y-%m-%d') AS date_end,
  CAST(floor((epoch_us(max(date)) - epoch_us(min(date))) / 86400000000) + 1 AS BIGINT) AS total_days, count(DISTINCT platform) AS platforms, count(DISTINCT app_version) AS versions,
  count(DISTINCT country) AS countries, count(DISTINCT user_segment) AS user_segments, count(DISTINCT subscription_tier) AS subscription_tiers,
  count(*) FILTER (sentiment = 'Negative') AS negative_count, count(*) FILTER (sentiment = 'Neutral') AS neutral_count, 0 AS positive_count,
  round_even(count(*) FILTER (sentiment = 'Negative') / count(*), 4) AS negative_share, round_even(count(*) FILTER (sentiment = 'Neutral') / count(*), 4) AS neutral_share, 0.0 AS positive_share,
  round_even(avg(sentiment_score), 4) AS average_sentiment_score, count(*) FILTER (is_feature_request) AS detected_feature_requests,
  date_diff('day', min({_MONDAY}), max({_MONDAY})) // 7 + 1 AS weekly_periods FROM picked GROUP BY 1),
statistics AS (SELECT s.*, (SELECT count(*) FROM pains p WHERE p.platform IS NOT DISTINCT FROM s.platform) AS detected_pain_themes FROM sums s),
leaves AS (""" + " UNION ALL ".join([
    _sql_leaves("pains", "'top_pain_points[' || (rank - 1) || '].'", (
        "rank", "theme", "review_count", "negative_review_count", "share_of_reviews", "average_rating"), key="platform"),
    _sql_leaves("sums", "'dataset.'", (
        "total_cleaned_reviews", "date_start", "date_end", "total_days", "platforms", "versions", "countries", "user_segments", "subscription_tiers"), key="platform"),
    _sql_leaves("sums", "'sentiment.'", ("negative_count", "neutral_count", "positive_count", *_SHARES, "average_sentiment_score"), key="platform"),
    _sql_leaves("statistics", "'context_statistics.'", (
        "cleaned_reviews=total_cleaned_reviews", "detected_feature_requests", "detected_pain_themes", "weekly_periods"), key="platform"),
]) + ")"


@query("insight_by_platform", PLATFORM_CTES, f"SELECT key AS platform, path, {NUMBERS_OR_TEXT} FROM leaves WHERE value IS NOT NULL", "number")
def _(spark, sf_dir):
    """Leaves of the contexts per platform of a filtered table, rows without a platform included."""
    insight = prepare_insight(stored(spark, sf_dir), {"sentiment": list(SELECTED)}, ["platform"], generated_at=STAMP)
    pain = [f"top_pain_points[{i}].{f}" for i in range(8) for f in ("rank", "theme", "review_count", "negative_review_count", "share_of_reviews", "average_rating")]
    compared: Column = F.col("path").rlike(r"^(dataset|sentiment|context_statistics)\.") | F.col("path").isin(pain)
    return _leaves(materialize(insight.context), "platform").filter(compared)


RAW_SUMMARY_CTES = NUMBERED_CTES + f""",
feedback AS (SELECT * FROM ({ORACLE['cleaned_table']}))""" + SUMMARY_CTES.removeprefix(FEEDBACK_CTES)


@query("analysis_of_raw_rows", RAW_SUMMARY_CTES, f"SELECT {', '.join(SUMMARY_COLUMNS)} FROM summary", "|".join(SUMMARY_DOUBLES))
def _(spark, sf_dir):
    """From the raw source to the theme summary: ingest, enrichment and aggregates in one plan."""
    return analyze_feedback(ingest(raw_feedback(spark, sf_dir), order_by="pos").dataframe).themes.select(*SUMMARY_COLUMNS)


@query("quote_findings", ANALYZED_CTES + f""", cited AS ({QUOTES_SQL})""", """SELECT primary_theme AS report_id, 'error' AS severity, 'evidence[' || (rank - 1) || ']' AS path,
  CASE rank WHEN 3 THEN 'Quote of ' || review_id || ' differs from its source text.' ELSE 'Quote of EV-none has no source text to compare with.' END AS message FROM cited WHERE rank IN (3, 4)
  UNION ALL SELECT primary_theme, 'error', NULL, 'The report cites reviews that the evidence does not hold.' FROM cited WHERE rank = 4
  UNION ALL SELECT DISTINCT primary_theme, 'error', NULL, 'No limitation is named in the confidence assessment.' FROM cited""")
def _(spark, sf_dir):
    """A report per theme cites all its quotes, the third altered and the fourth by an unknown id: findings on quotes and ids.

    Findings on numbers and on wording have queries of their own.
    """
    lists = materialize(quotes_by_theme(representative_quotes(stored(spark, sf_dir))))
    shown = F.transform("quotes", lambda q: F.struct(q["review_id"].alias("review_id"), q["original_text"].alias("review_text")))
    said = F.transform("quotes", lambda q, i: F.struct(
        F.when(i == 3, "EV-none").otherwise(q["review_id"]).alias("review_id"),
        F.when(i == 2, F.concat(q["original_text"], F.lit("!"))).otherwise(q["original_text"]).alias("quote"),
    ))
    evidence_of, report = (
        lists.select(F.col("primary_theme").alias("report_id"), F.to_json(F.struct(column.alias(name))).alias("document"))
        for column, name in ((shown, "representative_quotes"), (said, "evidence"))
    )
    found = validate_reports(report, evidence_of)
    return found.filter(F.col("message").rlike("^(Quote of|The report cites|No limitation)")).select("report_id", "severity", "path", "message")
