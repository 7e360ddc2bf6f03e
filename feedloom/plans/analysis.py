"""Clean feedback to enriched rows and every aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from feedloom.operators.metrics import feedback_cube, overall_metrics, request_summary, theme_summary
from feedloom.operators.quotes import representative_quotes
from feedloom.operators.signals import enrich
from feedloom.operators.trends import (
    calendar_week_negative,
    daily_volume,
    day_theme_volume,
    fastest_growing,
    theme_trends,
    theme_volume,
    weekly_volume,
)
from feedloom.vocab import Lexicon, RequestRules, ThemeRules


@dataclass(frozen=True)
class AnalysisResult:
    """Lazy results; nothing runs until one of them is read."""

    feedback: DataFrame
    daily: DataFrame
    weekly: DataFrame
    calendar_weeks: DataFrame
    theme_days: DataFrame
    trends: DataFrame
    fastest_growing: DataFrame
    themes: DataFrame
    overall: DataFrame
    requests: DataFrame
    quotes: DataFrame


def analyze_feedback(clean: DataFrame, *, lexicon: Lexicon | None = None, requests: RequestRules | None = None,
                     themes: ThemeRules | None = None, period_days: int = 14, persist: bool = False,
                     normalise: bool = False) -> AnalysisResult:
    """Enrich clean feedback and aggregate it.

    The text of clean feedback is already normalised; pass ``normalise`` for other text. ``persist`` keeps the
    enriched rows on the executors for the aggregates to share; writing them to a table and calling ``aggregate`` on
    what is read back does the same for larger data.
    """
    feedback = enrich(clean, lexicon=lexicon, requests=requests, themes=themes, normalise=normalise)
    if persist:
        feedback = feedback.persist(StorageLevel.MEMORY_AND_DISK)
    return aggregate(feedback, period_days=period_days)


def aggregate(feedback: DataFrame, *, period_days: int = 14) -> AnalysisResult:
    """Every aggregate of enriched feedback, filtered or not; enrichment does not run again."""
    volume = day_theme_volume(feedback)
    trends = theme_trends(volume, period_days=period_days)
    themes = theme_summary(feedback_cube(feedback), period_days=period_days)
    return AnalysisResult(
        feedback=feedback,
        daily=daily_volume(volume),
        weekly=weekly_volume(volume),
        calendar_weeks=calendar_week_negative(volume),
        theme_days=theme_volume(volume),
        trends=trends,
        fastest_growing=fastest_growing(trends),
        themes=themes,
        overall=overall_metrics(feedback, themes),
        requests=request_summary(feedback),
        quotes=representative_quotes(feedback),
    )
