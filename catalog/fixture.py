"""The ``feedback`` and ``raw_feedback`` views the registered queries run on.

Rows, dates, users, countries and segments come from events joined with customer and nation. The event table has no
text, so each row carries one of the sentences below, partly with its user number, which makes the number of
distinct texts grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import clean_text
from feedloom.sources.tables import read_table

SENTENCES = (
    "My dinner came as a late delivery again and the rider never called",
    "Payment failed twice at checkout and my money deducted anyway",
    "Please add a csv export for my yearly numbers",
    "Great app, everything is smooth and fast",
    "The app crashes every time I open the menu",
    "I need my refund, it was promised last week",
    "Would love a dark mode for reading at night",
    "Support did not reply to any of my three messages",
    "The food was cold and one item was missing",
    "otp not received so login impossible since monday",
    "<b>Terrible</b> evening, see https://example.com/photo for the proof of the wrong order",
    "It is okay",
    "not working",
    "Coupon expired before I could use the discount",
    "The courier app has a misleading estimate for delivery partner arrival",
    "Add recurring payment and bill reminder please",
    "Excellent service, the driver was polite and helpful!",
    "VERY slow loading after the latest update, but the new icons are nice",
    "Nothing to say really",
    "Need an option to freeze card and set a card limit",
    "Please introduce singing avatars for the lobby",
    "I was charged twice!! This is a scam",
    "Tracking stopped and the delivery status was wrong",
    "The restaurant cancelled and support was unhelpful",
    "Not bad at all, I really love this app",
    "Hidden charge on a small-order, pricing is not fair??",
    "app needs to stop crashing and please add live chat",
    "Allow team members to download report as pdf",
    "Friendly people and fresh food, thanks",
    "account blocked without reason, extremely disappointed",
    "show older statements and transaction history",
    "Best recommendations match my taste, personalized layout is useful",
)
SURGE, CRASH = 0, 4

# Release calendar of the view, oldest first.
RELEASES = (("2023-12-20", "3.8.0"), ("2024-01-05", "3.9.0"), ("2024-01-12", "3.10.0"), ("2024-01-20", "3.10.1"))
DEVICES = {"Android": ["Pixel 8", "Galaxy A54"], "iOS": ["iPhone 15", "iPad Air"], "Web": ["Chrome", "Firefox"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def releases(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(RELEASES), "released string, version string")
    return rows.select(F.to_date("released").alias("released"), "version")


def _release_of(day: Column) -> Column:
    version = F.lit(None).cast("string")
    for released, name in RELEASES:
        version = F.when(day >= F.lit(released).cast("date"), name).otherwise(version)
    return version


def events_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with its customer, country and sentence."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = events.join(customer, events.user_id == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    e, u = F.col("event_id"), F.col("user_id")
    day = F.to_date("ts")
    k = (
        F.when((day >= F.lit("2024-01-18").cast("date")) & (e % 7 == 0), SURGE)
        .when((_release_of(day) == "3.10.0") & (u % 3 == 0) & (e % 5 < 2), CRASH)
        .otherwise(e % 32)
    )
    sentence = F.element_at(F.array(*[F.lit(s) for s in SENTENCES]), (k + 1).cast("int"))
    text = F.when(e % 4 == 1, F.concat(sentence, F.lit(" (ticket "), u.cast("string"), F.lit(")"))).otherwise(sentence)
    platform = F.when(u % 3 == 0, "Android").when(u % 3 == 1, "iOS").otherwise("Web")
    device = F.lit(None).cast("string")
    for name, devices in DEVICES.items():
        for i, d in enumerate(devices):
            device = F.when((platform == name) & ((e % 2) == i), d).otherwise(device)
    rating = (
        F.when(e % 17 == 0, F.lit(None)).when(e % 29 == 0, 2.5).when(e % 31 == 0, 3.5)
        .otherwise((F.floor("value") % 5 + 1).cast("double"))
    )
    return joined.select(
        "event_id", "user_id", "event_type", "ts", text.alias("text"), rating.alias("rating"),
        F.when(e % 37 != 0, platform).alias("platform"), _release_of(day).alias("app_version"),
        F.col("n_name").alias("country"), F.when(e % 41 == 0, "Chrome").otherwise(device).alias("device"),
        F.col("c_mktsegment").alias("user_segment"),
        F.when(u % 4 == 0, "Free").when(u % 4 == 1, "Plus").when(u % 4 == 2, "Pro").alias("subscription_tier"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view in the clean schema, plus channel and subscription tier."""
    e = F.col("event_id")
    return events_with_text(spark, sf_dir).select(
        F.concat(F.lit("EV-"), F.lpad(e.cast("string"), 9, "0")).alias("review_id"),
        F.col("text").alias("original_text"),
        clean_text(F.col("text")).alias("clean_text"),
        F.when(e % 97 != 0, F.col("ts")).alias("date"),
        "rating", "platform", "app_version", "country", "device", "user_segment",
        (e + 2).alias("source_row_number"), "subscription_tier", F.col("event_type").alias("channel"),
    )


def raw_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as an untyped source with defects and appended exact copies. ``pos`` orders the rows."""
    e = F.col("event_id")
    rows = events_with_text(spark, sf_dir).select(
        e.alias("pos"),
        F.when(e % 41 != 0, F.concat(F.lit("EV-"), e.cast("string"))).alias("id"),
        F.when(e % 43 == 0, "  ").when(e % 5 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.col("text")).alias("content"),
        F.when(e % 23 == 0, "not-a-date").when(e % 47 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
        F.when(e % 19 == 0, "unknown").when(e % 19 == 1, "7").when(e % 19 == 2, " 4 ")
        .otherwise(F.col("rating").cast("string")).alias("score"),
        F.when(e % 3 == 0, F.concat(F.lit(" "), "platform", F.lit(" "))).otherwise(F.col("platform")).alias("source"),
        F.col("app_version").alias("version"), F.col("country").alias("region"), F.col("user_segment").alias("segment"),
    )
    copies = rows.filter(F.col("pos") % 50 == 7).withColumn("pos", F.col("pos") + F.lit(10**12))
    return rows.unionByName(copies)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_rows(rows) -> str:
    """A VALUES list."""
    def cell(v) -> str:
        return "NULL" if v is None else _quoted(v) if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


def _sql_release(day: str) -> str:
    cases = " ".join(f"WHEN {day} >= DATE '{d}' THEN '{v}'" for d, v in reversed(RELEASES))
    return f"CASE {cases} END"


def _sql_device() -> str:
    keys = {"Android": 0, "iOS": 1, "Web": 2}
    cases = " ".join(
        f"WHEN user_id % 3 = {keys[p]} AND event_id % 2 = {i} THEN '{d}'" for p, ds in DEVICES.items() for i, d in enumerate(ds)
    )
    return f"CASE WHEN event_id % 41 = 0 THEN 'Chrome' {cases} END"


EVENTS_CTES = f"""
sentences(k, txt) AS (SELECT * FROM {sql_rows(enumerate(SENTENCES))} v(k, txt)),
joined AS (
  SELECT e.*, c.c_mktsegment, n.n_name, CAST(e.ts AS DATE) AS day
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
chosen AS (
  SELECT *, {_sql_release('day')} AS version,
    CASE WHEN day >= DATE '2024-01-18' AND event_id % 7 = 0 THEN {SURGE}
         WHEN {_sql_release('day')} = '3.10.0' AND user_id % 3 = 0 AND event_id % 5 < 2 THEN {CRASH}
         ELSE event_id % 32 END AS k
  FROM joined),
ev AS (
  SELECT event_id, user_id, event_type, ts,
    CASE WHEN event_id % 4 = 1 THEN s.txt || ' (ticket ' || user_id || ')' ELSE s.txt END AS text,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 2.5 WHEN event_id % 31 = 0 THEN 3.5
         ELSE CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS DOUBLE) END AS rating,
    CASE WHEN event_id % 37 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'Android' WHEN user_id % 3 = 1 THEN 'iOS' ELSE 'Web' END AS platform,
    version AS app_version, n_name AS country, {_sql_device()} AS device, c_mktsegment AS user_segment,
    CASE user_id % 4 WHEN 0 THEN 'Free' WHEN 1 THEN 'Plus' WHEN 2 THEN 'Pro' END AS subscription_tier
  FROM chosen JOIN sentences s USING (k))"""


def sql_clean(column: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({column}, '<[^>]+>', ' ', 'g'), "
        f"'https?://[^\\s]+|www\\.[^\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


FEEDBACK_CTES = EVENTS_CTES + f""",
feedback AS (
  SELECT 'EV-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS review_id, text AS original_text,
    {sql_clean('text')} AS clean_text, CASE WHEN event_id % 97 <> 0 THEN ts END AS date,
    CAST(rating AS DOUBLE) AS rating, platform, app_version, country, device, user_segment,
    event_id + 2 AS source_row_number, subscription_tier, event_type AS channel
  FROM ev)"""

RAW_CTES = EVENTS_CTES + """,
raw_rows AS (
  SELECT event_id AS pos, CASE WHEN event_id % 41 <> 0 THEN 'EV-' || event_id END AS id,
    CASE WHEN event_id % 43 = 0 THEN '  ' WHEN event_id % 5 = 0 THEN '  ' || text || ' ' ELSE text END AS content,
    CASE WHEN event_id % 23 = 0 THEN 'not-a-date' WHEN event_id % 47 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at,
    CASE WHEN event_id % 19 = 0 THEN 'unknown' WHEN event_id % 19 = 1 THEN '7' WHEN event_id % 19 = 2 THEN ' 4 '
         ELSE CAST(CAST(rating AS DOUBLE) AS VARCHAR) END AS score,
    CASE WHEN event_id % 3 = 0 THEN ' ' || platform || ' ' ELSE platform END AS source,
    app_version AS version, country AS region, user_segment AS segment
  FROM ev),
raw_feedback AS (
  SELECT * FROM raw_rows
  UNION ALL SELECT pos + 1000000000000, id, content, created_at, score, source, version, region, segment FROM raw_rows WHERE pos % 50 = 7)"""
