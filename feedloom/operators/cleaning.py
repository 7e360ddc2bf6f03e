"""Cleaning: keep-first row dedupe, typed canonical columns, and the audit of what changed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import as_timestamp
from feedloom.functions.numbers import in_rating_range, parse_number
from feedloom.functions.text import clean_text, nonblank
from feedloom.operators.distinct import distinct_rows
from feedloom.operators.conform import conform, generated_id, tidy_categories
from feedloom.vocab.columns import CLEAN_COLUMNS

ROW = "source_row_number"
COPIES = "_copies"


def keep_first(df: DataFrame, order_by: str = ROW) -> DataFrame:
    """One row per distinct content, with the smallest row number and the number of copies seen.

    Only rows whose fingerprint repeats are shuffled; they are grouped by their content, so copies of a hot row collapse
    before the shuffle and no window has to hold them together. Nulls compare equal.
    """
    return distinct_rows(df, order_by, COPIES)


def flag_rows(df: DataFrame, mapping: Mapping[str, str | None] | None = None, *, normalise: bool = True) -> DataFrame:
    """Canonical typed columns for every distinct source row plus the flags the audit counts.

    ``df`` holds the source columns and ``source_row_number``.
    """
    rows = conform(keep_first(df), mapping, keep=(ROW, COPIES))
    date = as_timestamp(F.col("date"), rows.schema["date"].dataType.typeName())
    number = parse_number(F.col("rating"))
    rows = rows.select(
        "*",
        date.alias("_date"),
        F.when(in_rating_range(number), number).alias("_rating"),
    )
    rows = rows.select(
        generated_id(F.col("review_id"), F.col(ROW)).alias("review_id"),
        F.col("review_text").cast("string").alias("original_text"),
        clean_text(F.col("review_text"), normalise).alias("clean_text"),
        F.col("_date").alias("date"),
        F.col("_rating").alias("rating"),
        "platform", "app_version", "country", "device", "user_segment", ROW, COPIES,
        (~nonblank(F.col("review_text"))).alias("_blank"),
        (~nonblank(F.col("review_id"))).alias("_generated_id"),
        (nonblank(F.col("date")) & F.col("_date").isNull()).alias("_bad_date"),
        (nonblank(F.col("rating")) & F.col("_rating").isNull()).alias("_bad_rating"),
    )
    return tidy_categories(rows)


def cleaned(flagged: DataFrame) -> DataFrame:
    """The canonical clean table."""
    return flagged.filter(~F.col("_blank")).select(*CLEAN_COLUMNS)


def cleaning_report(flagged: DataFrame) -> DataFrame:
    """One row of audit counts. Defects are counted after duplicates and blank rows are gone."""
    kept = ~F.col("_blank")
    return flagged.agg(
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("input_rows"),
        F.count_if(kept).alias("output_rows"),
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("removed_duplicate_rows"),
        F.count_if(F.col("_blank")).alias("removed_missing_feedback_rows"),
        F.count_if(kept & F.col("_generated_id")).alias("generated_review_ids"),
        F.count_if(kept & F.col("_bad_date")).alias("invalid_dates_coerced"),
        F.count_if(kept & F.col("_bad_rating")).alias("invalid_ratings_coerced"),
    )


def cleaning_warnings(report_row) -> list[str]:
    """Readable notes for a collected report row."""
    notes = (
        ("removed_duplicate_rows", "Removed {:,} exact duplicate rows."),
        ("removed_missing_feedback_rows", "Removed {:,} blank feedback rows."),
        ("invalid_dates_coerced", "Cleared {:,} invalid date values."),
        ("invalid_ratings_coerced", "Cleared {:,} invalid rating values."),
    )
    return [text.format(report_row[name]) for name, text in notes if report_row[name]]
