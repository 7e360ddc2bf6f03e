"""Reader-facing views: renamed, rounded, ordered projections of feedback and summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.dates import iso_date
from feedloom.operators.filters import pain_only
from feedloom.operators.grouping import with_lists

# Source column -> heading, in display order.
EXECUTIVE = {
    "theme": "Theme", "frequency": "Mentions", "share_percentage": "Share", "average_rating": "Avg. Rating",
    "negative_percentage": "Negative Feedback", "severity_score": "Severity", "priority_score": "Priority",
    "priority_label": "Priority Level", "business_risk": "Business Risk",
}
FEEDBACK = {
    "review_id": "Review ID", "original_text": "Feedback", "rating": "Rating", "sentiment": "Sentiment",
    "primary_theme": "Theme", "subtheme": "Subtheme", "platform": "Platform", "app_version": "App Version",
    "date": "Date",
}
TECHNICAL = {
    "review_id": "Review ID", "classification_confidence": "Classification Confidence",
    "classification_method": "Classification Method", "sentiment_score": "Sentiment Score",
    "negativity_score": "Negativity Score", "feature_request_confidence": "Feature Request Confidence",
}
PAIN_POINTS = {
    "rank": "Rank", "theme": "Theme", "frequency": "Mentions", "share_percentage": "Share",
    "average_rating": "Avg. Rating", "negative_percentage": "Negative Feedback", "severity_score": "Severity",
    "trend_score": "Trend", "priority_score": "Priority", "priority_label": "Priority Level",
    "business_risk": "Business Risk", "average_confidence": "Confidence",
}
REQUESTS = {
    "feature_request_group": "Feature Request", "mentions": "Mentions", "share_percentage": "Share",
    "average_rating": "Avg. Rating", "request_confidence": "Confidence", "affected_platforms": "Platforms",
    "affected_user_segments": "User Segments",
}
ONE_DECIMAL = ("Share", "Avg. Rating", "Negative Feedback", "Severity", "Trend", "Priority", "Rating")
NOT_AVAILABLE = "Not available"


def _present(df: DataFrame, headings: Mapping[str, str], **custom: Column) -> DataFrame:
    def shown(source: str, heading: str) -> Column:
        if source in custom:
            return custom[source].alias(heading)
        c = F.col(source)
        if heading in ONE_DECIMAL:
            c = F.bround(c.cast("double"), 1)
        elif heading == "Confidence":
            c = F.bround(c.cast("double"), 2)
        return c.alias(heading)

    return df.select(*[shown(s, h) for s, h in headings.items() if s in df.columns])


def executive_view(summary: DataFrame) -> DataFrame:
    """Theme summary for reading, highest priority first."""
    ordered = summary.orderBy(F.desc("priority_score"), F.desc("frequency"), F.asc("theme"))
    return _present(ordered, EXECUTIVE)


def curated_view(df: DataFrame) -> DataFrame:
    custom = {"date": iso_date(F.col("date"))} if "date" in df.columns else {}
    return _present(df, FEEDBACK, **custom)


def technical_view(df: DataFrame) -> DataFrame:
    return _present(df, TECHNICAL)


def preview(df: DataFrame, rows: int = 100, order_by: str = "source_row_number") -> DataFrame:
    return df.orderBy(order_by).limit(rows)


def pain_point_view(summary: DataFrame) -> DataFrame:
    """Pain themes with their rank in summary order. The summary has one row per theme."""
    order = Window.orderBy(F.desc("priority_score"), F.desc("frequency"), F.asc("theme"))
    return _present(pain_only(summary).withColumn("rank", F.row_number().over(order)), PAIN_POINTS)


def request_view(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Request summary with the sorted platforms and user segments each group comes from."""
    requests = df.filter("is_feature_request")
    names = {"affected_platforms": "platform", "affected_user_segments": "user_segment"}
    lists = {n: c for n, c in names.items() if c in df.columns}
    affected = with_lists(summary, requests, ["feature_request_group"], {n: F.col(c) if n in lists else None for n, c in names.items()})
    joined = affected.withColumns({n: F.when(F.size(n) > 0, F.array_join(n, ", ")).otherwise(NOT_AVAILABLE) for n in names})
    return _present(joined, REQUESTS)


def label_candidates(summary: DataFrame, limit: int = 5) -> DataFrame:
    """Themes worth a label in a priority chart."""
    order = [F.desc("priority_score"), F.desc("severity_score"), F.desc("frequency"), F.asc("theme")]
    return summary.filter(~F.col("theme").isin("Positive Feedback", "Other")).orderBy(*order).limit(limit)


def top_requests(summary: DataFrame, limit: int = 10) -> DataFrame:
    return summary.orderBy(F.desc("mentions"), F.asc("feature_request_group")).limit(limit)


