"""Queries over the feedback views: ingest, quality, enrichment, metrics, trends, segments, quotes, evidence, views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.enrichment_sql import ANALYZED_CTES
from catalog.fixture import DEVICES, FEEDBACK_CTES, RAW_CTES, feedback, raw_feedback, releases, sql_rows, table
from catalog.fixture import RELEASES
from catalog.registry import query
from feedloom.functions.text import clean_text
from feedloom.operators import distinct, evidence, metrics, quality, quotes, segments, trends, views
from feedloom.operators import releases as rel
from feedloom.operators.cleaning import keep_first
from feedloom.operators.conform import conform, number_rows
from feedloom.operators.filters import apply_filters, date_bounds, filter_options
from feedloom.operators.grouping import attach, null_safe
from feedloom.operators.rule_tables import match_rule_table
from feedloom.operators.sentiment import add_sentiment_columns
from feedloom.operators.signals import STAGES, enrich
from feedloom.operators.themes import add_theme_signals, match_rules
from feedloom.plans.incremental import CubeTables
from feedloom.plans.ingest import ingest
from feedloom.session import materialize, shared_folder
from feedloom.vocab import ThemeRules
from feedloom.vocab.themes import CRITICAL_TERMS, RISK_SCORE, THEME_RISK


def analyzed(spark: SparkSession, sf_dir: str, *stages: str) -> DataFrame:
    return enrich(feedback(spark, sf_dir), stages or STAGES, normalise=False)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysed rows written once, for queries that read them several times."""
    return materialize(analyzed(spark, sf_dir))


def _volume(spark, sf_dir):
    return trends.day_theme_volume(analyzed(spark, sf_dir))


def _summary(spark, sf_dir):
    return metrics.summarize_themes(analyzed(spark, sf_dir))


# ---- ingest and quality -------------------------------------------------------------------------------------------

CANONICAL_SQL = """content AS review_text, id AS review_id, created_at AS date, score AS rating, source AS platform, version AS app_version,
  region AS country, CAST(NULL AS VARCHAR) AS device, segment AS user_segment"""


@query("canonical_projection", RAW_CTES, f"SELECT {CANONICAL_SQL} FROM raw_feedback")
def _(spark, sf_dir):
    return conform(raw_feedback(spark, sf_dir).drop("pos"))


@query("source_row_numbers", RAW_CTES, "SELECT pos, CAST(row_number() OVER (ORDER BY pos) + 1 AS BIGINT) AS source_row_number FROM raw_feedback")
def _(spark, sf_dir):
    return number_rows(raw_feedback(spark, sf_dir), "pos").select("pos", "source_row_number")


NUMBERED_CTES = RAW_CTES + """,
numbered AS (SELECT *, row_number() OVER (ORDER BY pos) + 1 AS source_row_number FROM raw_feedback),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, content, created_at, score, source, version, region, segment ORDER BY pos) AS rn,
  count(*) OVER (PARTITION BY id, content, created_at, score, source, version, region, segment) AS copies FROM numbered) WHERE rn = 1),
typed AS (SELECT *, trim(content) = '' AS blank, (id IS NULL OR trim(id) = '') AS no_id, try_cast(nullif(trim(created_at), '') AS TIMESTAMP) AS d,
  CASE WHEN try_cast(trim(score) AS DOUBLE) BETWEEN 1 AND 5 THEN try_cast(trim(score) AS DOUBLE) END AS r FROM kept)"""


@query("dedupe_keep_first", NUMBERED_CTES, """SELECT id, content, created_at, score, source, version, region, segment,
  CAST(source_row_number AS BIGINT) AS source_row_number, CAST(copies AS BIGINT) AS copies FROM kept""")
def _(spark, sf_dir):
    rows = number_rows(raw_feedback(spark, sf_dir), "pos").drop("pos")
    return keep_first(rows).withColumnRenamed("_copies", "copies")


@query("cleaned_table", NUMBERED_CTES, """SELECT CASE WHEN no_id THEN 'IF-' || lpad(CAST(source_row_number AS VARCHAR), 7, '0') ELSE id END AS review_id,
  content AS original_text, trim(regexp_replace(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), 'https?://[^\\s]+|www\\.[^\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS clean_text,
  d AS date, r AS rating, nullif(trim(source), '') AS platform, nullif(trim(version), '') AS app_version, nullif(trim(region), '') AS country,
  CAST(NULL AS VARCHAR) AS device, nullif(trim(segment), '') AS user_segment, CAST(source_row_number AS BIGINT) AS source_row_number
  FROM typed WHERE NOT blank""")
def _(spark, sf_dir):
    return ingest(raw_feedback(spark, sf_dir), order_by="pos").dataframe


@query("cleaning_report", NUMBERED_CTES, """SELECT CAST(sum(copies) AS BIGINT) AS input_rows, count(*) FILTER (NOT blank) AS output_rows,
  CAST(sum(copies - 1) AS BIGINT) AS removed_duplicate_rows, count(*) FILTER (blank) AS removed_missing_feedback_rows,
  count(*) FILTER (NOT blank AND no_id) AS generated_review_ids, count(*) FILTER (NOT blank AND trim(created_at) <> '' AND d IS NULL) AS invalid_dates_coerced,
  count(*) FILTER (NOT blank AND trim(score) <> '' AND r IS NULL) AS invalid_ratings_coerced FROM typed""")
def _(spark, sf_dir):
    return ingest(raw_feedback(spark, sf_dir), order_by="pos").report


@query("quality_summary", NUMBERED_CTES, """SELECT CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed, count(*) FILTER (NOT blank AND trim(created_at) <> '' AND d IS NULL) AS invalid_dates,
  count(*) FILTER (NOT blank AND trim(score) <> '' AND r IS NULL) AS invalid_ratings, count(*) FILTER (blank) AS blank_reviews, CAST(NULL AS BIGINT) AS missing_optional_values, CAST(0 AS BIGINT) AS notes FROM typed""")
def _(spark, sf_dir):
    summary = quality.quality_summary(ingest(raw_feedback(spark, sf_dir), order_by="pos").report)
    return summary.withColumn("notes", F.size("notes").cast("long"))


@query("validation_report", RAW_CTES, """SELECT count(*) AS row_count, CAST(8 AS BIGINT) AS column_count,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT id, content, created_at, score, source, version, region, segment FROM raw_feedback)) AS duplicate_row_count,
  count(*) FILTER (trim(content) <> '') - count(DISTINCT nullif(trim(content), '')) AS duplicate_text_count,
  count(*) FILTER (content IS NULL OR trim(content) = '') AS missing_feedback_count,
  count(*) FILTER (trim(created_at) <> '' AND try_cast(trim(created_at) AS TIMESTAMP) IS NULL) AS invalid_date_count,
  count(*) FILTER (trim(score) <> '' AND try_cast(trim(score) AS DOUBLE) IS NULL) AS invalid_rating_count,
  count(*) FILTER (try_cast(trim(score) AS DOUBLE) NOT BETWEEN 1 AND 5) AS out_of_range_rating_count,
  min(CASE WHEN try_cast(trim(score) AS DOUBLE) BETWEEN 1 AND 5 THEN try_cast(trim(score) AS DOUBLE) END) AS rating_min,
  max(CASE WHEN try_cast(trim(score) AS DOUBLE) BETWEEN 1 AND 5 THEN try_cast(trim(score) AS DOUBLE) END) AS rating_max,
  CAST(min(try_cast(nullif(trim(created_at), '') AS TIMESTAMP)) AS DATE) AS date_min, CAST(max(try_cast(nullif(trim(created_at), '') AS TIMESTAMP)) AS DATE) AS date_max FROM raw_feedback""")
def _(spark, sf_dir):
    return quality.validation_counts(raw_feedback(spark, sf_dir).drop("pos"))


@query("document_duplicates", sql="""SELECT count(*) AS row_count, CAST(4 AS BIGINT) AS column_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicate_row_count,
  count(*) FILTER (trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') - count(DISTINCT nullif(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '')) AS duplicate_text_count,
  count(*) FILTER (text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '') AS missing_feedback_count FROM documents""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").drop("doc_id")
    counts = quality.validation_counts(docs, {"review_text": "text"})
    return counts.select("row_count", "column_count", "duplicate_row_count", "duplicate_text_count", "missing_feedback_count")


_CLASS_SQL = """CASE WHEN v IS NULL OR trim(v) = '' THEN NULL WHEN regexp_matches(trim(v), '^[+-]?\\d+$') THEN 'int'
  WHEN regexp_matches(trim(v), '^[+-]?(\\d+\\.\\d*|\\.\\d+)([eE][+-]?\\d+)?$|^[+-]?\\d+[eE][+-]?\\d+$') THEN 'float' WHEN lower(trim(v)) IN ('true', 'false') THEN 'bool'
  WHEN regexp_matches(trim(v), '^\\d{4}-\\d{2}-\\d{2}([ T]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?)?$') THEN 'date' ELSE 'text' END"""
_CELLS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS v FROM raw_feedback" for c in ("id", "content", "created_at", "score", "source", "version", "region", "segment")
)
_COUNTS_SQL = ", ".join(f"count(*) FILTER (k = '{k}') AS {k}_values" for k in ("int", "float", "bool", "date", "text"))


@query("mixed_type_profile", RAW_CTES, f"SELECT column_name, {_COUNTS_SQL}, count(DISTINCT k) > 1 AS is_mixed FROM (SELECT column_name, {_CLASS_SQL} AS k FROM ({_CELLS_SQL})) GROUP BY column_name")
def _(spark, sf_dir):
    return quality.mixed_type_profile(raw_feedback(spark, sf_dir).drop("pos"))


_CALENDAR_SQL = f"SELECT * FROM {sql_rows(RELEASES)} v(released, version)"
_DEVICE_SQL = " OR ".join(
    f"(lower(trim(platform)) = '{p.lower()}' AND NOT coalesce(device IN ({', '.join(repr(d) for d in ds)}), FALSE))" for p, ds in DEVICES.items()
)


@query("expectations", FEEDBACK_CTES + f""", cal AS ({_CALENDAR_SQL}), with_release AS (
  SELECT f.*, (SELECT version FROM cal WHERE CAST(released AS DATE) <= CAST(f.date AS DATE) ORDER BY released DESC LIMIT 1) AS expected FROM feedback f)""",
f"""SELECT rule, failing_rows, failing_rows = 0 AS passed FROM (
  SELECT 'platform has an allowed value' AS rule, count(*) FILTER (platform IS NOT NULL AND lower(trim(platform)) NOT IN ('android', 'ios', 'web')) AS failing_rows FROM feedback
  UNION ALL SELECT 'version matches the release calendar', count(*) FILTER (date IS NOT NULL AND app_version IS DISTINCT FROM expected) FROM with_release
  UNION ALL SELECT 'device fits platform', count(*) FILTER ({_DEVICE_SQL}) FROM feedback
  UNION ALL SELECT 'original_text has no contact data', count(*) FILTER (regexp_matches(original_text, 'https?://|www\\.|[\\w.+-]+@[\\w.-]+\\.\\w+|\\+?\\d[\\d -]{{8,}}\\d')) FROM feedback
  UNION ALL SELECT 'review_id is unique', count(*) - count(DISTINCT review_id) FROM feedback
  UNION ALL SELECT 'original_text is unique', count(*) - count(DISTINCT original_text) FROM feedback)""")
def _(spark, sf_dir):
    rows = feedback(spark, sf_dir)
    dated = rel.fill_release(rows, releases(spark))
    late = F.col("date").isNotNull() & ~F.col("app_version").eqNullSafe(F.col("expected_version"))
    checked = quality.check_expectations(dated, [
        quality.allowed_values("platform", ["Android", "iOS", "Web"]),
        quality.Expectation("version matches the release calendar", late),
        quality.allowed_pairs("platform", "device", DEVICES),
        quality.no_contact_data("original_text"),
    ])
    return checked.unionByName(quality.unique_values(rows, "review_id")).unionByName(quality.unique_values(rows, "original_text"))


WS_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS_SQL = WS_SQL.replace("[", "[^", 1)


@query("page_text_cleaning", sql=f"""SELECT page_id, md5(t) AS text_hash, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT page_id,
  trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://{NOT_WS_SQL}+|www\\.{NOT_WS_SQL}+', ' ', 'g'), '{WS_SQL}+', ' ', 'g')) AS t FROM pages)""")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", clean_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.md5("t").alias("text_hash"), F.length("t").cast("long").alias("n_chars"))


# ---- filters ------------------------------------------------------------------------------------------------------

SELECTED = {"date_range": ("2024-01-05", "2024-01-25"), "platform": ["Android", "iOS"], "rating": [1.0, 2.0, 3.0], "sentiment": ["Negative"], "country": []}


@query("filtered_feedback", ANALYZED_CTES, """SELECT review_id, platform, rating, sentiment, primary_theme FROM analyzed
  WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND platform IN ('Android', 'iOS') AND rating IN (1, 2, 3) AND sentiment = 'Negative'""")
def _(spark, sf_dir):
    return apply_filters(analyzed(spark, sf_dir), SELECTED).select("review_id", "platform", "rating", "sentiment", "primary_theme")


_OPTIONS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value FROM analyzed" for c in
    ("platform", "rating", "country", "device", "app_version", "primary_theme", "sentiment", "user_segment")
)


@query("filter_options", ANALYZED_CTES, f"SELECT dimension, value, count(*) AS rows FROM ({_OPTIONS_SQL}) WHERE value IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    return filter_options(analyzed(spark, sf_dir))


@query("date_bounds", FEEDBACK_CTES, "SELECT CAST(min(date) AS DATE) AS first_day, CAST(max(date) AS DATE) AS last_day FROM feedback")
def _(spark, sf_dir):
    return date_bounds(feedback(spark, sf_dir))


@query("theme_drilldown", ANALYZED_CTES, "SELECT review_id, subtheme, classification_confidence FROM analyzed WHERE primary_theme = 'Payment and Checkout' AND sentiment = 'Negative'",
       "classification_confidence")
def _(spark, sf_dir):
    rows = apply_filters(analyzed(spark, sf_dir), {"primary_theme": ["Payment and Checkout"], "sentiment": ["Negative"]})
    return rows.select("review_id", "subtheme", "classification_confidence")


# ---- enrichment ---------------------------------------------------------------------------------------------------

@query("sentiment_in_plan", ANALYZED_CTES, "SELECT review_id, sentiment, sentiment_score, negativity_score, sentiment_method FROM analyzed",
       "sentiment_score|negativity_score")
def _(spark, sf_dir):
    rows = add_sentiment_columns(feedback(spark, sf_dir), in_plan=True)
    return rows.select("review_id", "sentiment", "sentiment_score", "negativity_score", "sentiment_method")


@query("sentiment_hybrid", ANALYZED_CTES, "SELECT review_id, sentiment, sentiment_score, negativity_score, sentiment_method FROM analyzed",
       "sentiment_score|negativity_score")
def _(spark, sf_dir):
    return analyzed(spark, sf_dir, "sentiment").select("review_id", "sentiment", "sentiment_score", "negativity_score", "sentiment_method")


REQUEST_COLUMNS = ("is_feature_request", "feature_request_detected", "feature_request_text", "feature_request_confidence",
                   "feature_request_group", "feature_request_method", "feature_request_matched_terms", "feature_request_score")


@query("request_detection_wide_letters", ANALYZED_CTES, f"SELECT review_id, {', '.join(REQUEST_COLUMNS)} FROM analyzed", "feature_request_confidence|feature_request_score")
def _(spark, sf_dir):
    """The same texts in full-width letters: normalisation brings back the plain ones."""
    plain = "abcdefghijklmnopqrstuvwxyz"
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain)
    rows = feedback(spark, sf_dir).withColumn("clean_text", F.translate("clean_text", plain, wide))
    return enrich(rows, ["requests"], normalise=True).select("review_id", *REQUEST_COLUMNS)


@query("request_detection", ANALYZED_CTES, f"SELECT review_id, {', '.join(REQUEST_COLUMNS)} FROM analyzed", "feature_request_confidence|feature_request_score")
def _(spark, sf_dir):
    return analyzed(spark, sf_dir, "requests").select("review_id", *REQUEST_COLUMNS)


@query("theme_rules", ANALYZED_CTES, "SELECT review_id, primary_theme, secondary_theme, subtheme, classification_confidence, classification_method FROM analyzed",
       "classification_confidence")
def _(spark, sf_dir):
    return analyzed(spark, sf_dir).select(
        "review_id", "primary_theme", "secondary_theme", "subtheme", "classification_confidence", "classification_method"
    )


@query("tfidf_fallback", ANALYZED_CTES, "SELECT review_id, primary_theme, subtheme, classification_confidence FROM analyzed WHERE classification_method = 'tfidf_similarity'",
       "classification_confidence")
def _(spark, sf_dir):
    rows = analyzed(spark, sf_dir).filter(F.col("classification_method") == "tfidf_similarity")
    return rows.select("review_id", "primary_theme", "subtheme", "classification_confidence")


DOCUMENT_RULES = (
    ("Licensing", "Notice", ("all rights reserved", "mit license", "permission is hereby granted"), ("license", "copyright", "licensed")),
    ("Contact", "Mail", ("reach me at", "call me"), ("mail", "email", "phone")),
    ("Secrets", "Key", ("api key", "private key"), ("password", "token", "secret")),
    ("Language", "Function words", ("of the", "in the"), ("the", "der", "les", "el")),
)
_DOC_TERMS = [(i, t, 3) for i, r in enumerate(DOCUMENT_RULES) for t in r[2]] + [(i, t, 1) for i, r in enumerate(DOCUMENT_RULES) for t in r[3]]


@query("document_rules", f"""doc_terms(r, term, points) AS (SELECT * FROM {sql_rows(_DOC_TERMS)} v(r, term, points)),
doc_rules(r, theme, subtheme) AS (SELECT * FROM {sql_rows((i, r[0], r[1]) for i, r in enumerate(DOCUMENT_RULES))} v(r, theme, subtheme)),
low AS (SELECT doc_id, trim(regexp_replace(lower(text), '{WS_SQL}+', ' ', 'g')) AS t FROM documents),
split AS (SELECT doc_id, t, string_split_regex(t, '[^\\p{{L}}\\p{{N}}_]+') AS w FROM low),
scores AS (SELECT doc_id, r, theme, subtheme, sum(points) AS score FROM split JOIN doc_terms ON
  CASE WHEN contains(term, ' ') OR contains(term, '-') THEN contains(t, term) ELSE list_contains(w, term) END JOIN doc_rules USING (r) GROUP BY ALL)""",
"""SELECT doc_id, theme, subtheme, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, r) AS rk FROM scores) WHERE rk = 1""", "score")
def _(spark, sf_dir):
    rules = ThemeRules.from_rows(DOCUMENT_RULES)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("clean_text"))
    matched = match_rules(add_theme_signals(docs, rules), rules).filter(F.col("_match").isNotNull())
    return matched.select("doc_id", "_match.theme", "_match.subtheme", "_match.score")


def _rule_frame(spark, rules) -> DataFrame:
    rows = [(i, r.theme, r.subtheme, list(r.phrases), list(r.keywords)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_idx int, theme string, subtheme string, phrases array<string>, keywords array<string>")


def _part_rules(spark, sf_dir, start: int) -> DataFrame:
    """One rule for every part: its name as a phrase, its key as a keyword."""
    parts = table(spark, sf_dir, "part")
    return parts.select((F.col("p_partkey") + start).cast("int").alias("rule_idx"), F.lit("Part").alias("theme"), F.col("p_name").alias("subtheme"),
                        F.array(F.lower("p_name")).alias("phrases"), F.array(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("keywords"))


@query("document_rule_table", f"""part_terms AS (SELECT CAST(p_partkey + 100 AS INT) AS r, 'Part' AS theme, p_name AS subtheme, unnest([lower(p_name), 'p' || p_partkey]) AS term, unnest([3, 1]) AS points FROM part),
doc_terms AS (SELECT r, theme, subtheme, term, points FROM {sql_rows(_DOC_TERMS)} t(r, term, points) JOIN {sql_rows((i, r[0], r[1]) for i, r in enumerate(DOCUMENT_RULES))} v(r, theme, subtheme) USING (r)
  UNION ALL SELECT * FROM part_terms),
low AS (SELECT doc_id, trim(regexp_replace(lower(text), '{WS_SQL}+', ' ', 'g')) AS t FROM documents),
split AS (SELECT doc_id, t, list_distinct(string_split_regex(t, '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM low),
hits AS (SELECT doc_id, r, theme, subtheme, points FROM split JOIN doc_terms ON (contains(term, ' ') OR contains(term, '-')) AND contains(t, term)
  UNION ALL SELECT doc_id, r, theme, subtheme, points FROM (SELECT doc_id, unnest(w) AS term FROM split) s JOIN doc_terms USING (term) WHERE NOT contains(term, ' ') AND NOT contains(term, '-')),
scores AS (SELECT doc_id, r, theme, subtheme, sum(points) AS score FROM hits GROUP BY ALL)""",
"""SELECT doc_id, theme, subtheme, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, r) AS rk FROM scores) WHERE rk = 1""", "score")
def _(spark, sf_dir):
    """The rules of ``document_rules`` and one for every part, as a table that grows with the data."""
    rules = _rule_frame(spark, ThemeRules.from_rows(DOCUMENT_RULES).rules).unionByName(_part_rules(spark, sf_dir, 100))
    return match_rule_table(table(spark, sf_dir, "documents"), rules, "doc_id", "text").select("doc_id", "theme", "subtheme", "score")


@query("theme_rule_table", ANALYZED_CTES, """SELECT f.review_id, t.theme, t.subtheme, CAST(t.score AS DOUBLE) AS score, t.phrase = 1 AS by_phrase, x.secondary
  FROM feedback f JOIN rule_top t USING (clean_text) LEFT JOIN rule_second x USING (clean_text)""", "score")
def _(spark, sf_dir):
    rules = _rule_frame(spark, ThemeRules.default().rules).unionByName(_part_rules(spark, sf_dir, 1000))
    return match_rule_table(feedback(spark, sf_dir), rules, "review_id")


# ---- metrics ------------------------------------------------------------------------------------------------------

_CRITICAL = " OR ".join(f"contains(lower(clean_text), '{t}')" for t in CRITICAL_TERMS)
SUMMARY_CTES = ANALYZED_CTES + f""",
theme_risk(theme, risk) AS (SELECT * FROM {sql_rows(THEME_RISK.items())} v(theme, risk)),
risk_scores(risk, risk_score) AS (SELECT * FROM {sql_rows(RISK_SCORE.items())} v(risk, risk_score)),
theme_agg AS (
  SELECT primary_theme AS theme, count(*) AS frequency, avg(rating) AS average_rating,
    100.0 * avg(CASE WHEN sentiment = 'Negative' THEN 1.0 ELSE 0.0 END) AS negative_percentage, avg(sentiment_score) AS average_sentiment_score,
    avg(classification_confidence) AS average_confidence, count(*) FILTER ({_CRITICAL}) AS critical_count,
    count(*) FILTER (sentiment = 'Negative') AS negative_count, 100.0 * count(*) / (SELECT count(*) FROM analyzed) AS share_percentage
  FROM analyzed GROUP BY 1),
dominant AS (
  SELECT theme, subtheme FROM (SELECT primary_theme AS theme, subtheme, row_number() OVER (PARTITION BY primary_theme ORDER BY count(*) DESC, subtheme) AS rk
    FROM analyzed GROUP BY primary_theme, subtheme) WHERE rk = 1),
dated AS (SELECT *, CAST(date AS DATE) AS day FROM analyzed WHERE date IS NOT NULL),
span AS (SELECT max(day) AS last_day, date_diff('day', min(day), max(day)) + 1 AS coverage FROM dated),
counts AS (
  SELECT primary_theme AS theme,
    count(*) FILTER (coverage >= 14 AND day BETWEEN last_day - 13 AND last_day) AS recent_count,
    count(*) FILTER (coverage >= 14 AND day BETWEEN last_day - 27 AND last_day - 14) AS previous_count
  FROM dated, span GROUP BY 1),
theme_trend AS (
  SELECT *, greatest(-1.0, least(1.0, (recent_count - previous_count) / (previous_count + 1.0))) AS growth_rate,
    greatest(0.0, least(100.0, 50 + 50 * greatest(-1.0, least(1.0, (recent_count - previous_count) / (previous_count + 1.0))))) AS trend_score,
    (recent_count - previous_count) / 14.0 AS issue_velocity FROM counts),
components AS (
  SELECT a.*, d.subtheme, coalesce(t.trend_score, 50.0) AS trend_score, coalesce(t.growth_rate, 0.0) AS growth_rate, coalesce(t.issue_velocity, 0.0) AS issue_velocity,
    coalesce(r.risk, 'Customer satisfaction risk') AS business_risk, 100.0 * frequency / (SELECT max(frequency) FROM theme_agg) AS frequency_component,
    negative_percentage AS negative_component, coalesce((5 - average_rating) / 4 * 100, 50.0) AS rating_component, coalesce(t.trend_score, 50.0) AS trend_component,
    least(100.0, 100.0 * critical_count / frequency) AS critical_keyword_component, coalesce(s.risk_score, 50.0) AS business_risk_component,
    average_confidence * 100 AS confidence_component,
    critical_count > 0 AND frequency <= greatest(3, round_even((SELECT count(*) FROM analyzed) * 0.02, 0)) AS rare
  FROM theme_agg a LEFT JOIN dominant d USING (theme) LEFT JOIN theme_trend t USING (theme) LEFT JOIN theme_risk r USING (theme) LEFT JOIN risk_scores s ON s.risk = r.risk),
severities AS (SELECT *, 0.30 * negative_component + 0.25 * rating_component + 0.20 * frequency_component + 0.15 * trend_component + 0.10 * critical_keyword_component AS sev FROM components),
priorities AS (SELECT *, 0.30 * frequency_component + 0.30 * sev + 0.20 * trend_component + 0.10 * business_risk_component + 0.10 * confidence_component AS pri FROM severities),
summary AS (
  SELECT *, CASE WHEN rare THEN greatest(sev, 70.0) ELSE sev END AS severity_score, CASE WHEN rare THEN greatest(pri, 60.0) ELSE pri END AS priority_score,
    CASE WHEN CASE WHEN rare THEN greatest(pri, 60.0) ELSE pri END >= 80 THEN 'P0 Critical' WHEN CASE WHEN rare THEN greatest(pri, 60.0) ELSE pri END >= 60 THEN 'P1 High'
      WHEN pri >= 40 THEN 'P2 Medium' ELSE 'P3 Low' END AS priority_label
  FROM priorities)"""
NOT_PAIN = "('Positive Feedback', 'Feature Request', 'Other')"


@query("theme_aggregate", SUMMARY_CTES, """SELECT theme, frequency, average_rating, negative_percentage, average_sentiment_score, average_confidence, share_percentage FROM theme_agg""",
       "average_rating|negative_percentage|average_sentiment_score|average_confidence|share_percentage")
def theme_aggregate(spark, sf_dir):
    cube = metrics.feedback_cube(analyzed(spark, sf_dir))
    return metrics.theme_aggregate(cube).drop("critical_count", "negative_count", "total_rows")


@query("dominant_subtheme", SUMMARY_CTES, "SELECT theme, subtheme FROM dominant")
def _(spark, sf_dir):
    return metrics.dominant_subtheme(metrics.feedback_cube(analyzed(spark, sf_dir)))


@query("critical_terms", SUMMARY_CTES, "SELECT theme, critical_count, least(100.0, 100.0 * critical_count / frequency) AS critical_component FROM theme_agg", "critical_component")
def _(spark, sf_dir):
    themes = metrics.theme_aggregate(metrics.feedback_cube(analyzed(spark, sf_dir)))
    return themes.select("theme", "critical_count", F.least(F.lit(100.0), F.col("critical_count") * 100.0 / F.col("frequency")).alias("critical_component"))


SUMMARY_DOUBLES = ("average_rating", "negative_percentage", "average_sentiment_score", "average_confidence", "share_percentage", "trend_score", "growth_rate",
                   "issue_velocity", "severity_score", "priority_score", "frequency_component", "negative_component", "rating_component", "trend_component",
                   "critical_keyword_component", "business_risk_component", "confidence_component")
SUMMARY_COLUMNS = ("theme", "frequency", "subtheme", "business_risk", "priority_label", *SUMMARY_DOUBLES)


@query("theme_summary", SUMMARY_CTES, f"SELECT {', '.join(SUMMARY_COLUMNS)} FROM summary", "|".join(SUMMARY_DOUBLES))
def _(spark, sf_dir):
    return metrics.in_priority_order(_summary(spark, sf_dir)).select(*SUMMARY_COLUMNS)


@query("theme_explanations", SUMMARY_CTES, """SELECT theme, printf('Severity combines negative sentiment (%.1f), rating impact (%.1f), frequency (%.1f), trend (%.1f), and critical terms (%.1f).',
    negative_component, rating_component, frequency_component, trend_component, critical_keyword_component) AS severity_explanation,
  printf('Priority combines frequency (%.1f), severity (%.1f), trend (%.1f), business risk (%.1f), and confidence (%.1f)', frequency_component, severity_score, trend_component,
    business_risk_component, confidence_component) || CASE WHEN rare THEN ' with a rare-critical safeguard.' ELSE '.' END AS priority_explanation FROM summary""")
def _(spark, sf_dir):
    return _summary(spark, sf_dir).select("theme", "severity_explanation", "priority_explanation")


@query("overall_metrics", SUMMARY_CTES, f"""SELECT count(*) AS total_feedback_items, count(DISTINCT original_text) AS total_unique_feedback_items, avg(rating) AS average_rating,
  100.0 * count(*) FILTER (sentiment = 'Positive') / count(*) AS positive_feedback_percentage, 100.0 * count(*) FILTER (sentiment = 'Neutral') / count(*) AS neutral_feedback_percentage,
  100.0 * count(*) FILTER (sentiment = 'Negative') / count(*) AS negative_feedback_percentage, count(DISTINCT primary_theme) AS detected_theme_count,
  count(*) FILTER (is_feature_request) AS feature_request_count,
  (SELECT theme FROM summary WHERE theme NOT IN {NOT_PAIN} ORDER BY frequency DESC, theme LIMIT 1) AS most_frequent_pain_point,
  (SELECT theme FROM theme_trend WHERE theme NOT IN {NOT_PAIN} ORDER BY trend_score DESC, recent_count DESC, theme LIMIT 1) AS fastest_growing_pain_point FROM analyzed""",
  "average_rating|positive_feedback_percentage|neutral_feedback_percentage|negative_feedback_percentage")
def _(spark, sf_dir):
    rows = stored(spark, sf_dir)
    return metrics.overall_metrics(rows, metrics.summarize_themes(rows))


REQUEST_SUMMARY_SQL = """SELECT feature_request_group, count(*) AS mentions, avg(rating) AS average_rating, avg(feature_request_confidence) AS request_confidence,
  100.0 * count(*) / (SELECT count(*) FROM analyzed) AS share_percentage FROM analyzed WHERE is_feature_request GROUP BY 1"""


@query("request_summary", ANALYZED_CTES, REQUEST_SUMMARY_SQL, "average_rating|request_confidence|share_percentage")
def _(spark, sf_dir):
    return metrics.in_mention_order(metrics.request_summary(analyzed(spark, sf_dir, "requests")))


@query("kpi_picks", SUMMARY_CTES + f", rs AS ({REQUEST_SUMMARY_SQL})", f"""SELECT p.theme AS top_pain, p.frequency, p.priority_label,
  (SELECT feature_request_group FROM rs ORDER BY mentions DESC, feature_request_group LIMIT 1) AS most_requested,
  (SELECT feature_request_group FROM rs ORDER BY round(request_confidence, 9) DESC, mentions DESC, feature_request_group LIMIT 1) AS highest_confidence
  FROM (SELECT * FROM summary WHERE theme NOT IN {NOT_PAIN} ORDER BY frequency DESC, priority_score DESC LIMIT 1) p""")
def _(spark, sf_dir):
    rows = stored(spark, sf_dir)
    requests = metrics.request_summary(rows).withColumn("request_confidence", F.round("request_confidence", 9))
    pain = metrics.top_pain_point(metrics.summarize_themes(rows))
    return attach(pain, metrics.leading_groups(requests), ()).select(
        F.col("theme").alias("top_pain"), "frequency", "priority_label", "most_requested", "highest_confidence"
    )


# ---- trends -------------------------------------------------------------------------------------------------------

@query("daily_volume", SUMMARY_CTES, "SELECT day, count(*) AS feedback_count, 100.0 * count(*) FILTER (sentiment = 'Negative') / count(*) AS negative_percentage FROM dated GROUP BY 1", "negative_percentage")
def _(spark, sf_dir):
    return trends.daily_volume(_volume(spark, sf_dir))


_WEEK = "day + CAST((8 - isodow(day)) % 7 AS INT)"
WEEKS_SQL = f"""SELECT CAST(g.week AS DATE) AS week, count(d.day) AS feedback_count, 100.0 * count(*) FILTER (d.sentiment = 'Negative') / nullif(count(d.day), 0) AS negative_percentage
  FROM (SELECT unnest(generate_series(min({_WEEK}), max({_WEEK}), INTERVAL 7 DAY)) AS week FROM dated) g LEFT JOIN dated d ON d.{_WEEK.replace('isodow(day)', 'isodow(d.day)')} = g.week GROUP BY 1"""


@query("weekly_volume", SUMMARY_CTES, WEEKS_SQL, "negative_percentage")
def _(spark, sf_dir):
    return trends.weekly_volume(_volume(spark, sf_dir))


@query("calendar_week_negative", SUMMARY_CTES, f"""SELECT CAST({_WEEK} - 6 AS DATE) AS week_start, count(*) AS total_feedback, count(*) FILTER (sentiment = 'Negative') AS negative_count,
  100.0 * count(*) FILTER (sentiment = 'Negative') / count(*) AS negative_percentage FROM dated GROUP BY 1""", "negative_percentage")
def _(spark, sf_dir):
    return trends.calendar_week_negative(_volume(spark, sf_dir))


@query("rolling_volume", SUMMARY_CTES, """SELECT day, rolling_mean FROM (SELECT day, avg(n) OVER w AS rolling_mean, count(*) OVER w AS frame FROM (
  SELECT CAST(g.day AS DATE) AS day, count(d.day) AS n FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM dated) g LEFT JOIN dated d ON d.day = g.day GROUP BY 1)
  WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) WHERE frame = 7""", "rolling_mean")
def _(spark, sf_dir):
    return trends.rolling_volume(_volume(spark, sf_dir))


@query("theme_day_volume", SUMMARY_CTES, "SELECT day, primary_theme, count(*) AS feedback_count FROM dated WHERE primary_theme IN ('App Performance', 'Payment and Checkout') GROUP BY 1, 2")
def _(spark, sf_dir):
    return trends.theme_volume(_volume(spark, sf_dir), themes=["App Performance", "Payment and Checkout"])


@query("theme_trends", SUMMARY_CTES, "SELECT theme, recent_count, previous_count, growth_rate, trend_score, issue_velocity FROM theme_trend", "growth_rate|trend_score|issue_velocity")
def _(spark, sf_dir):
    return trends.theme_trends(_volume(spark, sf_dir)).drop("coverage_days")


@query("fastest_growing", SUMMARY_CTES, f"SELECT theme AS fastest_growing_pain_point FROM theme_trend WHERE theme NOT IN {NOT_PAIN} ORDER BY trend_score DESC, recent_count DESC, theme LIMIT 1")
def _(spark, sf_dir):
    return trends.fastest_growing(trends.theme_trends(_volume(spark, sf_dir)))


GROWTH_CTES = ANALYZED_CTES + """, ends AS (SELECT max(date) AS e FROM analyzed), req_growth AS (
  SELECT feature_request_group, count(*) FILTER (date BETWEEN e - INTERVAL 13 DAY AND e) AS recent_count,
    count(*) FILTER (date BETWEEN e - INTERVAL 27 DAY AND e - INTERVAL 14 DAY) AS previous_count
  FROM analyzed, ends WHERE is_feature_request GROUP BY 1)"""
GROWTH_SQL = """SELECT feature_request_group, recent_count, previous_count,
  round_even(greatest(-1.0, least(1.0, (recent_count - previous_count) / (previous_count + 1.0))), 4) AS growth_rate FROM req_growth"""


@query("request_growth", GROWTH_CTES, GROWTH_SQL, "growth_rate")
def _(spark, sf_dir):
    return evidence.request_growth(analyzed(spark, sf_dir, "requests"))


ORDERS_CTES = """dated AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS theme FROM orders WHERE o_orderdate IS NOT NULL)"""


def _order_volume(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("primary_theme"), F.lit("Neutral").alias("sentiment")
    )
    return trends.day_theme_volume(rows)


@query("order_adaptive_volume", ORDERS_CTES, f"""SELECT 'Weekly' AS aggregation, CAST(g.week AS DATE) AS period, count(d.day) AS feedback_count
  FROM (SELECT unnest(generate_series(min({_WEEK}), max({_WEEK}), INTERVAL 7 DAY)) AS week FROM dated) g LEFT JOIN dated d ON d.{_WEEK.replace('isodow(day)', 'isodow(d.day)')} = g.week GROUP BY 1, 2""")
def _(spark, sf_dir):
    return trends.adaptive_volume(_order_volume(spark, sf_dir))


@query("event_adaptive_volume", SUMMARY_CTES, "SELECT 'Daily' AS aggregation, day AS period, count(*) AS feedback_count FROM dated GROUP BY 1, 2")
def _(spark, sf_dir):
    """Few enough days are covered to show each of them."""
    return trends.adaptive_volume(_volume(spark, sf_dir))


@query("short_coverage_trends", SUMMARY_CTES, """SELECT primary_theme AS theme, CAST(0 AS BIGINT) AS recent_count, CAST(0 AS BIGINT) AS previous_count, CAST(0 AS DOUBLE) AS growth_rate, CAST(50 AS DOUBLE) AS trend_score,
  CAST(0 AS DOUBLE) AS issue_velocity, date_diff('day', (SELECT min(day) FROM dated), max(max(day)) OVER ()) + 1 AS coverage_days FROM dated WHERE day < (SELECT min(day) FROM dated) + 10 GROUP BY 1""",
  "growth_rate|trend_score|issue_velocity")
def _(spark, sf_dir):
    """The first ten days alone are too few for a trend, so every theme is neutral."""
    volume = _volume(spark, sf_dir)
    first = volume.select(F.min("day").alias("first"))
    early = volume.where(F.col("day") < F.date_add(first.scalar(), 10))
    return trends.theme_trends(early).withColumn("coverage_days", F.col("coverage_days").cast("long"))


# ---- aggregates that follow new rows ------------------------------------------------------------------------------

def _batches(spark, sf_dir) -> CubeTables:
    """Three batches by the hour of the event, the second of them added twice, as after a failure."""
    tables = CubeTables(spark, f"{shared_folder(spark).rstrip('/')}/cubes-{uuid.uuid4().hex}")
    rows = feedback(spark, sf_dir)
    part = F.col("source_row_number") % 3
    for name, number in (("1", 0), ("2", 1), ("2", 1), ("3", 2)):
        tables.add(name, rows.where(part == number))
    return tables


@query("incremental_theme_summary", SUMMARY_CTES, f"SELECT {', '.join(SUMMARY_COLUMNS)} FROM summary", "|".join(SUMMARY_DOUBLES))
def _(spark, sf_dir):
    return _batches(spark, sf_dir).themes().select(*SUMMARY_COLUMNS)


@query("incremental_weeks", SUMMARY_CTES, WEEKS_SQL, "negative_percentage")
def _(spark, sf_dir):
    return _batches(spark, sf_dir).weekly()


@query("incremental_distinct_texts", FEEDBACK_CTES, "SELECT platform, count(*) AS rows, count(DISTINCT original_text) AS distinct_texts, TRUE AS within_error FROM feedback GROUP BY 1")
def _(spark, sf_dir):
    """The exact number of texts per platform, and whether the estimate from the merged sketches lies within its error."""
    exact = distinct.distinct_counts(feedback(spark, sf_dir), "original_text", ("platform",), "distinct_texts")
    joined = null_safe(_batches(spark, sf_dir).distinct_texts(), exact, ["platform"])
    near = F.abs(F.col("estimate") - F.col("distinct_texts")) <= F.col("distinct_texts") * distinct.SKETCH_ERROR
    return joined.select("platform", "rows", "distinct_texts", near.alias("within_error"))


# ---- segments -----------------------------------------------------------------------------------------------------

@query("dataset_summary", FEEDBACK_CTES, """SELECT CAST(NULL AS BIGINT) AS total_raw_reviews, count(*) AS total_cleaned_reviews, strftime(min(date), '%Y-%m-%d') AS date_start, strftime(max(date), '%Y-%m-%d') AS date_end,
  CAST(floor((epoch_us(max(date)) - epoch_us(min(date))) / 86400000000) + 1 AS BIGINT) AS total_days, count(DISTINCT platform) AS platforms, count(DISTINCT app_version) AS versions,
  count(DISTINCT country) AS countries, count(DISTINCT user_segment) AS user_segments, count(DISTINCT subscription_tier) AS subscription_tiers FROM feedback""")
def _(spark, sf_dir):
    return segments.dataset_summary(feedback(spark, sf_dir))


@query("sentiment_summary", ANALYZED_CTES, "SELECT " + ", ".join(
    f"count(*) FILTER (sentiment = '{s}') AS {s.lower()}_count, round_even(count(*) FILTER (sentiment = '{s}') / count(*), 4) AS {s.lower()}_share" for s in segments.SENTIMENTS
) + ", round_even(avg(sentiment_score), 4) AS average_sentiment_score FROM analyzed", "negative_share|neutral_share|positive_share|average_sentiment_score")
def _(spark, sf_dir):
    return segments.sentiment_summary(analyzed(spark, sf_dir, "sentiment"))


@query("rating_summary", FEEDBACK_CTES, """SELECT round_even(avg(rating), 4) AS average_rating, round_even(median(rating), 4) AS median_rating, """ + ", ".join(
    f"count(*) FILTER (round_even(rating, 0) = {i}) AS {n}_star_count" for i, n in enumerate(("one", "two", "three", "four", "five"), 1)
) + """, round_even(count(*) FILTER (rating IN (1, 2)) / count(rating), 4) AS low_rating_share, round_even(count(*) FILTER (rating IN (4, 5)) / count(rating), 4) AS high_rating_share FROM feedback""",
  "average_rating|median_rating|low_rating_share|high_rating_share")
def _(spark, sf_dir):
    return segments.rating_summary(feedback(spark, sf_dir))


_DIM_SQL = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, * FROM analyzed WHERE trim({d}) <> ''" for d in segments.DIMENSIONS)
SEGMENT_CTES = ANALYZED_CTES + f""", dims AS ({_DIM_SQL}),
seg AS (SELECT dimension, value, count(*) AS review_count, round_even(count(*) FILTER (sentiment = 'Negative') / count(*), 4) AS negative_share,
  round_even(count(*) FILTER (sentiment = 'Positive') / count(*), 4) AS positive_share, round_even(avg(rating), 4) AS average_rating,
  row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, value) AS rank FROM dims GROUP BY 1, 2),
pain AS (SELECT dimension, value, primary_theme, row_number() OVER (PARTITION BY dimension, value ORDER BY count(*) DESC, primary_theme) AS rk FROM dims WHERE primary_theme NOT IN {NOT_PAIN} GROUP BY 1, 2, 3),
reqs AS (SELECT dimension, value, feature_request_group, row_number() OVER (PARTITION BY dimension, value ORDER BY count(*) DESC, feature_request_group) AS rk FROM dims WHERE is_feature_request GROUP BY 1, 2, 3)"""


@query("segment_insights", SEGMENT_CTES, """SELECT s.dimension, s.value, review_count, negative_share, positive_share, average_rating, CAST(rank AS INT) AS rank, p.primary_theme AS top_pain_point,
  r.feature_request_group AS top_feature_request FROM seg s LEFT JOIN pain p ON p.dimension = s.dimension AND p.value = s.value AND p.rk = 1
  LEFT JOIN reqs r ON r.dimension = s.dimension AND r.value = s.value AND r.rk = 1 WHERE rank <= 6""", "negative_share|positive_share|average_rating")
def _(spark, sf_dir):
    return segments.segment_insights(analyzed(spark, sf_dir))


@query("incremental_segments", SEGMENT_CTES, """SELECT s.dimension, s.value, review_count, negative_share, positive_share, average_rating, CAST(rank AS INT) AS rank, p.primary_theme AS top_pain_point,
  r.feature_request_group AS top_feature_request FROM seg s LEFT JOIN pain p ON p.dimension = s.dimension AND p.value = s.value AND p.rk = 1
  LEFT JOIN reqs r ON r.dimension = s.dimension AND r.value = s.value AND r.rk = 1 WHERE rank <= 6""", "negative_share|positive_share|average_rating")
def _(spark, sf_dir):
    return _batches(spark, sf_dir).segments()


@query("price_median", sql="""SELECT l_returnflag AS returnflag, round_even(median(l_quantity / 12.5), 4) AS median_rating, round_even(avg(l_quantity / 12.5), 4) AS average_rating FROM lineitem WHERE l_quantity / 12.5 BETWEEN 1 AND 5 GROUP BY 1""",
       doubles="median_rating|average_rating")
def _(spark, sf_dir):
    """Medians of many values: quantities brought into the range of ratings."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("returnflag"), (F.col("l_quantity") / 12.5).alias("rating"))
    return segments.rating_summary(lines, ["returnflag"]).select("returnflag", "median_rating", "average_rating")


@query("theme_segment_crosstab", ANALYZED_CTES, """SELECT t.theme, s.segment, count(a.review_id) AS mentions FROM (SELECT DISTINCT primary_theme AS theme FROM analyzed WHERE platform IS NOT NULL) t, (SELECT DISTINCT platform AS segment FROM analyzed WHERE platform IS NOT NULL) s
  LEFT JOIN analyzed a ON a.primary_theme = t.theme AND a.platform = s.segment GROUP BY 1, 2""")
def _(spark, sf_dir):
    return segments.theme_segment_crosstab(analyzed(spark, sf_dir), "platform")


@query("theme_segment_matrix", ANALYZED_CTES, """SELECT primary_theme AS theme, count(*) FILTER (platform = 'Android') AS "Android", count(*) FILTER (platform = 'Web') AS "Web", count(*) FILTER (platform = 'iOS') AS "iOS"
  FROM analyzed WHERE platform IS NOT NULL GROUP BY 1""")
def _(spark, sf_dir):
    return segments.theme_segment_matrix(analyzed(spark, sf_dir), "platform", ["Android", "Web", "iOS"])


@query("sentiment_distribution", ANALYZED_CTES, """SELECT s AS sentiment, count(a.sentiment) AS count, 100.0 * count(a.sentiment) / (SELECT count(*) FROM analyzed) AS percentage
  FROM (VALUES ('Negative'), ('Neutral'), ('Positive')) v(s) LEFT JOIN analyzed a ON a.sentiment = s GROUP BY 1""", "percentage")
def _(spark, sf_dir):
    return segments.sentiment_distribution(analyzed(spark, sf_dir, "sentiment"))


@query("rating_distribution", FEEDBACK_CTES, """SELECT s AS rating, count(f.rating) AS count, 100.0 * count(f.rating) / (SELECT count(rating) FROM feedback) AS percentage
  FROM (VALUES (1), (2), (3), (4), (5)) v(s) LEFT JOIN feedback f ON round_even(f.rating, 0) = s GROUP BY 1""", "percentage")
def _(spark, sf_dir):
    return segments.rating_distribution(feedback(spark, sf_dir))


@query("top_themes", ANALYZED_CTES, "SELECT primary_theme AS theme, count(*) AS mentions, 100.0 * count(*) / (SELECT count(*) FROM analyzed) AS share FROM analyzed WHERE primary_theme <> 'Other' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "share")
def _(spark, sf_dir):
    return segments.top_themes(analyzed(spark, sf_dir))


@query("sentiment_by_version", ANALYZED_CTES, "SELECT app_version, sentiment, count(*) AS feedback FROM analyzed WHERE app_version IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    return segments.counts_by(analyzed(spark, sf_dir, "sentiment"), "app_version", "sentiment")


@query("complaints_by_country", ANALYZED_CTES, "SELECT country, count(*) AS complaints FROM analyzed WHERE sentiment = 'Negative' AND country IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return segments.negatives_by(analyzed(spark, sf_dir, "sentiment"), "country")


@query("rating_by_platform", FEEDBACK_CTES, "SELECT platform, avg(rating) AS average_rating FROM feedback WHERE platform IS NOT NULL GROUP BY 1", "average_rating")
def _(spark, sf_dir):
    return segments.mean_rating_by(feedback(spark, sf_dir), "platform")


@query("requests_by_segment", ANALYZED_CTES, "SELECT user_segment, count(*) AS requests FROM analyzed WHERE is_feature_request AND user_segment IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return segments.requests_by(analyzed(spark, sf_dir, "requests"), "user_segment")


_TOP_DIMS = ("platform", "app_version", "country", "device", "user_segment")
_TOP_SQL = " UNION ALL ".join(f"SELECT primary_theme, '{d}' AS dimension, {d} AS value FROM analyzed WHERE trim({d}) <> ''" for d in _TOP_DIMS)


@query("theme_top_values", ANALYZED_CTES, f"""SELECT * FROM (SELECT primary_theme, dimension, value, count(*) AS rows, CAST(row_number() OVER (PARTITION BY primary_theme, dimension ORDER BY count(*) DESC, value) AS INT) AS rank
  FROM ({_TOP_SQL}) GROUP BY 1, 2, 3) WHERE rank <= 5""")
def _(spark, sf_dir):
    return segments.top_values_per_theme(analyzed(spark, sf_dir), _TOP_DIMS)


# ---- releases -----------------------------------------------------------------------------------------------------

@query("release_asof", FEEDBACK_CTES + f", cal AS ({_CALENDAR_SQL})", """SELECT review_id, (SELECT version FROM cal WHERE CAST(released AS DATE) <= CAST(f.date AS DATE) ORDER BY released DESC LIMIT 1) AS expected_version FROM feedback f""")
def _(spark, sf_dir):
    return rel.fill_release(feedback(spark, sf_dir), releases(spark)).select("review_id", "expected_version")


@query("order_release_asof", """cal AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS released, 'wave-' || strftime(min(o_orderdate), '%Y%m') AS version FROM orders GROUP BY 1)""",
"""SELECT l_orderkey, l_linenumber, (SELECT version FROM cal WHERE released <= CAST(l_shipdate AS DATE) ORDER BY released DESC LIMIT 1) AS expected_version FROM lineitem""")
def _(spark, sf_dir):
    """Every shipped line with the latest monthly order wave on or before its ship date."""
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("released")).agg(
        F.concat(F.lit("wave-"), F.date_format(F.min("o_orderdate"), "yyyyMM")).alias("version")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return rel.fill_release(lines, orders, "l_shipdate").drop("l_shipdate")


MATRIX_CTES = ANALYZED_CTES + """, watched(theme, platform) AS (SELECT * FROM (VALUES ('App Performance', 'Android'), ('Payment and Checkout', NULL)) v(theme, platform)),
mat AS (SELECT w.theme, w.platform, a.app_version AS version, count(*) AS rows, count(*) FILTER (a.primary_theme = w.theme) AS theme_rows
  FROM analyzed a JOIN watched w ON w.platform IS NULL OR a.platform = w.platform WHERE trim(a.app_version) <> '' GROUP BY ALL),
ordered AS (SELECT *, theme_rows / rows AS share, lag(theme_rows / rows) OVER o AS before, lead(theme_rows / rows) OVER o AS after FROM mat
  WINDOW o AS (PARTITION BY theme, platform ORDER BY CAST(string_split(version, '.') AS INT[]), version)),
based AS (SELECT *, share - (coalesce(before, after) + coalesce(after, before)) / 2 AS change FROM ordered)"""


@query("release_matrix", MATRIX_CTES, "SELECT theme, platform, version, rows, CAST(theme_rows AS BIGINT) AS theme_rows, theme_rows / rows AS share FROM mat", "share")
def _(spark, sf_dir):
    return rel.release_matrix(analyzed(spark, sf_dir)).withColumnsRenamed({"watched_theme": "theme", "watched_platform": "platform"})


@query("release_stories", MATRIX_CTES, """SELECT 'Observed ' || theme || ' ' || CASE WHEN change > 0 THEN 'increase' ELSE 'decrease' END || ' in version ' || version AS title, version, platform, theme || ' share' AS metric_name,
  round_even(before, 4) AS before_value, round_even(share, 4) AS during_value, round_even(after, 4) AS after_value, CASE WHEN change > 0 THEN 'increase' ELSE 'decrease' END AS direction,
  round_even(change, 4) AS magnitude, (SELECT string_agg(review_id, '|' ORDER BY review_id) FROM (SELECT review_id FROM analyzed a WHERE a.primary_theme = b.theme AND a.app_version = b.version AND (b.platform IS NULL OR a.platform = b.platform) ORDER BY review_id LIMIT 3)) AS ids
  FROM based b WHERE abs(change) >= 0.05 AND theme_rows > 0""", "before_value|during_value|after_value|magnitude")
def _(spark, sf_dir):
    stories = rel.release_stories(stored(spark, sf_dir), limit=1000).withColumnRenamed("watched_platform", "platform")
    return stories.withColumn("ids", F.array_join("supporting_review_ids", "|")).drop("supporting_review_ids", "evidence_note", "rank")


@query("top_release_stories", MATRIX_CTES, """SELECT title, rank FROM (SELECT 'Observed ' || theme || ' ' || CASE WHEN change > 0 THEN 'increase' ELSE 'decrease' END || ' in version ' || version AS title,
  CAST(row_number() OVER (ORDER BY abs(round_even(change, 4)) DESC, version, theme || ' share') AS INT) AS rank FROM based WHERE abs(change) >= 0.05 AND theme_rows > 0) WHERE rank <= 2""")
def _(spark, sf_dir):
    return rel.release_stories(stored(spark, sf_dir), limit=2).select("title", "rank")


# ---- quotes -------------------------------------------------------------------------------------------------------

QUOTES_SQL = """SELECT review_id, original_text, date, rating, platform, primary_theme, CAST(rk AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY primary_theme ORDER BY CASE WHEN sentiment = CASE WHEN primary_theme = 'Positive Feedback' THEN 'Positive' ELSE 'Negative' END THEN 1 ELSE 0 END DESC,
    classification_confidence DESC, CASE WHEN length(trim(original_text)) BETWEEN 20 AND 400 THEN 1 ELSE 0 END DESC, review_id) AS rk
  FROM (SELECT *, row_number() OVER (PARTITION BY primary_theme, trim(original_text) ORDER BY source_row_number) AS first FROM analyzed WHERE trim(original_text) <> '') WHERE first = 1) WHERE rk <= 5"""


@query("representative_quotes", ANALYZED_CTES, QUOTES_SQL)
def _(spark, sf_dir):
    return quotes.representative_quotes(analyzed(spark, sf_dir))


@query("quote_lists", ANALYZED_CTES, f"SELECT primary_theme, string_agg(review_id, '|' ORDER BY rank) AS ids FROM ({QUOTES_SQL}) GROUP BY 1")
def _(spark, sf_dir):
    lists = quotes.quotes_by_theme(quotes.representative_quotes(analyzed(spark, sf_dir)))
    return lists.select("primary_theme", F.array_join(F.transform("quotes", lambda q: q["review_id"]), "|").alias("ids"))


IDS_SQL = """SELECT primary_theme AS theme, review_id, CAST(rk AS INT) AS rank FROM (SELECT primary_theme, review_id, row_number() OVER (PARTITION BY primary_theme
  ORDER BY CASE WHEN sentiment = 'Negative' THEN 1 ELSE 0 END DESC, classification_confidence DESC, review_id) AS rk FROM analyzed) WHERE rk <= 3"""


@query("representative_ids", ANALYZED_CTES, IDS_SQL)
def _(spark, sf_dir):
    return quotes.representative_ids(analyzed(spark, sf_dir))


@query("request_ids", ANALYZED_CTES, """SELECT feature_request_group, review_id, CAST(rk AS INT) AS rank FROM (SELECT feature_request_group, review_id, row_number() OVER (PARTITION BY feature_request_group
  ORDER BY feature_request_confidence DESC, review_id) AS rk FROM analyzed WHERE is_feature_request) WHERE rk <= 3""")
def _(spark, sf_dir):
    return quotes.request_ids(analyzed(spark, sf_dir, "requests"))


@query("request_quotes", ANALYZED_CTES, """SELECT feature_request_group, original_text, review_id, platform, feature_request_confidence, CAST(rk AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY feature_request_group ORDER BY feature_request_confidence DESC, review_id) AS rk FROM (
    SELECT *, row_number() OVER (PARTITION BY feature_request_group, original_text ORDER BY feature_request_confidence DESC, review_id) AS first FROM analyzed WHERE is_feature_request) WHERE first = 1) WHERE rk <= 5""",
  "feature_request_confidence")
def _(spark, sf_dir):
    return quotes.request_quotes(analyzed(spark, sf_dir, "requests"))


@query("quote_grounding", ANALYZED_CTES, f"""SELECT q.review_id, q.primary_theme FROM (SELECT review_id, CASE WHEN rank = 5 THEN original_text || '!' ELSE original_text END AS original_text,
  CASE WHEN rank = 4 THEN 'Other' ELSE primary_theme END AS primary_theme FROM ({QUOTES_SQL})) q ANTI JOIN analyzed a ON a.review_id = q.review_id AND a.original_text = q.original_text AND a.primary_theme = q.primary_theme""")
def _(spark, sf_dir):
    """Quotes with some texts and themes altered: exactly the altered ones are ungrounded."""
    rows = stored(spark, sf_dir)
    altered = quotes.representative_quotes(rows).select(
        "review_id", F.when(F.col("rank") == 5, F.concat("original_text", F.lit("!"))).otherwise(F.col("original_text")).alias("original_text"),
        F.when(F.col("rank") == 4, "Other").otherwise(F.col("primary_theme")).alias("primary_theme"),
    )
    return quotes.ungrounded_quotes(altered, rows).select("review_id", "primary_theme")


# ---- evidence -----------------------------------------------------------------------------------------------------

RANK_SQL = " UNION ALL ".join(
    f"""SELECT '{s}' AS section, theme, frequency, CAST(rk AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY coalesce(round({m}, 9), 0) DESC, frequency DESC, theme) AS rk FROM summary WHERE theme NOT IN {NOT_PAIN}) WHERE rk <= 8"""
    for s, m in evidence.PAIN_SECTIONS.items()
)


@query("pain_rankings", SUMMARY_CTES, RANK_SQL)
def _(spark, sf_dir):
    return evidence.pain_rankings(_summary(spark, sf_dir)).select("section", "theme", "frequency", "rank")


@query("pain_records", SUMMARY_CTES + f", ranked AS ({RANK_SQL}), ids AS ({IDS_SQL})", """SELECT r.section, r.rank, r.theme, s.frequency AS review_count, s.negative_count AS negative_review_count,
  round_even(s.frequency / (SELECT count(*) FROM analyzed), 4) AS share_of_reviews, round_even(s.average_rating, 4) AS average_rating, s.business_risk,
  CASE WHEN round_even(s.growth_rate, 4) > 0.05 THEN 'growing' WHEN round_even(s.growth_rate, 4) < -0.05 THEN 'declining' ELSE 'stable' END AS trend_direction, round_even(s.growth_rate, 4) AS growth_rate,
  (SELECT string_agg(DISTINCT platform, '|' ORDER BY platform) FROM analyzed a WHERE a.primary_theme = r.theme) AS platforms,
  (SELECT string_agg(DISTINCT app_version, '|' ORDER BY app_version) FROM analyzed a WHERE a.primary_theme = r.theme) AS versions,
  (SELECT string_agg(review_id, '|' ORDER BY rank) FROM ids i WHERE i.theme = r.theme) AS ids FROM ranked r JOIN summary s USING (theme)""", "share_of_reviews|average_rating|growth_rate")
def _(spark, sf_dir):
    rows = stored(spark, sf_dir)
    records = evidence.pain_records(rows, metrics.summarize_themes(rows))
    return records.select(
        "section", "rank", "theme", "review_count", "negative_review_count", "share_of_reviews", "average_rating", "business_risk", "trend_direction", "growth_rate",
        F.array_join("affected_platforms", "|").alias("platforms"), F.array_join("affected_versions", "|").alias("versions"), F.array_join("representative_review_ids", "|").alias("ids"),
    )


REQUEST_INSIGHTS_SQL = """SELECT CAST(row_number() OVER (ORDER BY request_count DESC, average_confidence DESC, "group") AS INT) AS rank, * FROM (
  SELECT feature_request_group AS "group", count(*) AS request_count, round_even(count(*) / (SELECT count(*) FROM analyzed WHERE is_feature_request), 4) AS share_of_requests,
    round_even(avg(feature_request_confidence), 4) AS average_confidence, any_value(growth_rate) AS growth_rate, CASE WHEN any_value(growth_rate) > 0.05 THEN 'growing' WHEN any_value(growth_rate) < -0.05 THEN 'declining' ELSE 'stable' END AS trend_direction,
    string_agg(DISTINCT platform, '|' ORDER BY platform) AS platforms, string_agg(DISTINCT user_segment, '|' ORDER BY user_segment) AS user_segments
  FROM analyzed JOIN g USING (feature_request_group) WHERE is_feature_request GROUP BY 1) ORDER BY rank LIMIT 8"""


@query("request_insights", GROWTH_CTES + f", g AS ({GROWTH_SQL})", REQUEST_INSIGHTS_SQL, "share_of_requests|average_confidence|growth_rate")
def _(spark, sf_dir):
    found = evidence.request_insights(materialize(analyzed(spark, sf_dir, "requests")))
    return found.select(
        "rank", "group", "request_count", "share_of_requests", "average_confidence", "growth_rate", "trend_direction",
        F.array_join("affected_platforms", "|").alias("platforms"), F.array_join("affected_segments", "|").alias("user_segments"),
    )


GREEDY_CTES = "RECURSIVE " + SUMMARY_CTES + GROWTH_CTES.removeprefix(ANALYZED_CTES) + f""", g AS ({GROWTH_SQL}), insights AS ({REQUEST_INSIGHTS_SQL}), ranked AS ({RANK_SQL}),
wanted AS (SELECT 'pain_point' AS kind, theme AS k, rank AS position FROM ranked WHERE section = 'top_pain_points' AND rank <= {evidence.PAIN_QUOTES}
  UNION ALL SELECT 'feature_request', "group", rank + {evidence.PAIN_QUOTES} FROM insights WHERE rank <= {evidence.REQUEST_QUOTES}),
cands AS MATERIALIZED (
  SELECT dense_rank() OVER (ORDER BY w.position) AS step, w.kind, a.*, row_number() OVER (PARTITION BY w.position ORDER BY CASE WHEN w.kind = 'pain_point' AND a.sentiment = 'Negative' THEN 1 ELSE 0 END DESC,
    CASE w.kind WHEN 'pain_point' THEN a.classification_confidence ELSE a.feature_request_confidence END DESC, a.review_id, a.source_row_number, a.original_text) AS rk
  FROM wanted w JOIN analyzed a ON CASE w.kind WHEN 'pain_point' THEN a.primary_theme = w.k ELSE a.feature_request_group = w.k END WHERE trim(a.original_text) <> ''),
picks(step, rk, ids, texts) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT step, rk, ids, texts FROM (
    SELECT p.step + 1 AS step, c.rk, CASE WHEN c.rk IS NULL THEN p.ids ELSE list_append(p.ids, c.review_id) END AS ids, CASE WHEN c.rk IS NULL THEN p.texts ELSE list_append(p.texts, c.original_text) END AS texts,
      row_number() OVER (ORDER BY c.rk) AS best
    FROM picks p LEFT JOIN cands c ON c.step = p.step + 1 AND NOT list_contains(p.ids, c.review_id) AND NOT list_contains(p.texts, c.original_text)
    WHERE p.step < (SELECT max(step) FROM cands)) n WHERE best = 1)"""


@query("unique_quote_evidence", GREEDY_CTES, """SELECT CAST(row_number() OVER (ORDER BY c.step) AS INT) AS rank, c.review_id, c.original_text AS review_text, c.rating, strftime(c.date, '%Y-%m-%d') AS date, c.platform, c.app_version,
  c.sentiment AS sentiment_label, c.primary_theme AS pain_point_theme, c.feature_request_group, c.kind AS evidence_type, CAST(c.source_row_number AS BIGINT) AS source_row_index
  FROM picks p JOIN cands c ON c.step = p.step AND c.rk = p.rk ORDER BY c.step LIMIT 16""")
def _(spark, sf_dir):
    rows = stored(spark, sf_dir)
    pain = evidence.pain_rankings(metrics.summarize_themes(rows))
    groups = evidence.quote_groups(pain, evidence.request_insights(rows))
    return quotes.unique_quote_evidence(rows, groups).select("rank", "quote.*")


STAMP = "2024-02-01T00:00:00+00:00"


@query("platform_contexts")
def _(spark, sf_dir):
    """One compact evidence context per platform, rows without one included, all in one job."""
    rows = stored(spark, sf_dir)
    return evidence.compact_insight_context(evidence.context_rows(rows, ["platform"], generated_at=STAMP), ["platform"], max_characters=9_000)


# ---- views --------------------------------------------------------------------------------------------------------

@query("executive_view", SUMMARY_CTES, """SELECT theme AS "Theme", frequency AS "Mentions", round_even(share_percentage, 1) AS "Share", round_even(average_rating, 1) AS "Avg. Rating",
  round_even(negative_percentage, 1) AS "Negative Feedback", round_even(severity_score, 1) AS "Severity", round_even(priority_score, 1) AS "Priority", priority_label AS "Priority Level", business_risk AS "Business Risk" FROM summary""",
  "Share|Avg. Rating|Negative Feedback|Severity|Priority")
def _(spark, sf_dir):
    return views.executive_view(_summary(spark, sf_dir))


@query("pain_point_view", SUMMARY_CTES, f"""SELECT CAST(row_number() OVER (ORDER BY priority_score DESC, frequency DESC, theme) AS INT) AS "Rank", theme AS "Theme", frequency AS "Mentions", round_even(share_percentage, 1) AS "Share",
  round_even(average_rating, 1) AS "Avg. Rating", round_even(negative_percentage, 1) AS "Negative Feedback", round_even(severity_score, 1) AS "Severity", round_even(trend_score, 1) AS "Trend", round_even(priority_score, 1) AS "Priority",
  priority_label AS "Priority Level", business_risk AS "Business Risk", round_even(average_confidence, 2) AS "Confidence" FROM summary WHERE theme NOT IN {NOT_PAIN}""", "Share|Avg. Rating|Negative Feedback|Severity|Trend|Priority|Confidence")
def _(spark, sf_dir):
    return views.pain_point_view(_summary(spark, sf_dir))


@query("curated_view", ANALYZED_CTES, """SELECT review_id AS "Review ID", original_text AS "Feedback", round_even(rating, 1) AS "Rating", sentiment AS "Sentiment", primary_theme AS "Theme", subtheme AS "Subtheme",
  platform AS "Platform", app_version AS "App Version", strftime(date, '%Y-%m-%d') AS "Date" FROM analyzed""", "Rating")
def _(spark, sf_dir):
    return views.curated_view(analyzed(spark, sf_dir))


@query("technical_view", ANALYZED_CTES, """SELECT review_id AS "Review ID", classification_confidence AS "Classification Confidence", classification_method AS "Classification Method", sentiment_score AS "Sentiment Score",
  negativity_score AS "Negativity Score", feature_request_confidence AS "Feature Request Confidence" FROM analyzed""", "Classification Confidence|Sentiment Score|Negativity Score|Feature Request Confidence")
def _(spark, sf_dir):
    return views.technical_view(analyzed(spark, sf_dir))


@query("feedback_preview", FEEDBACK_CTES, "SELECT review_id, original_text, source_row_number FROM feedback ORDER BY source_row_number LIMIT 100")
def _(spark, sf_dir):
    return views.preview(feedback(spark, sf_dir)).select("review_id", "original_text", "source_row_number")


@query("request_view", ANALYZED_CTES, f"""SELECT r.feature_request_group AS "Feature Request", mentions AS "Mentions", round_even(share_percentage, 1) AS "Share", round_even(average_rating, 1) AS "Avg. Rating", round_even(request_confidence, 2) AS "Confidence",
  coalesce(x.p, 'Not available') AS "Platforms", coalesce(x.s, 'Not available') AS "User Segments" FROM ({REQUEST_SUMMARY_SQL}) r LEFT JOIN (SELECT feature_request_group, string_agg(DISTINCT platform, ', ' ORDER BY platform) AS p,
  string_agg(DISTINCT user_segment, ', ' ORDER BY user_segment) AS s FROM analyzed WHERE is_feature_request GROUP BY 1) x USING (feature_request_group)""", "Share|Avg. Rating|Confidence")
def _(spark, sf_dir):
    rows = materialize(analyzed(spark, sf_dir, "requests"))
    return views.request_view(rows, metrics.request_summary(rows))


@query("label_candidates", SUMMARY_CTES, "SELECT theme, frequency, severity_score, priority_score FROM summary WHERE theme NOT IN ('Positive Feedback', 'Other') ORDER BY priority_score DESC, severity_score DESC, frequency DESC, theme LIMIT 5", "severity_score|priority_score")
def _(spark, sf_dir):
    return views.label_candidates(_summary(spark, sf_dir)).select("theme", "frequency", "severity_score", "priority_score")


@query("top_requests", ANALYZED_CTES, f"SELECT feature_request_group, mentions FROM ({REQUEST_SUMMARY_SQL}) ORDER BY mentions DESC, feature_request_group LIMIT 10")
def _(spark, sf_dir):
    return views.top_requests(metrics.request_summary(analyzed(spark, sf_dir, "requests"))).select("feature_request_group", "mentions")
