"""Filtered feedback to evidence contexts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from feedloom.operators.evidence import DEFAULT_BUDGET, assemble, compact_insight_context, context_rows
from feedloom.operators.filters import apply_filters


@dataclass(frozen=True)
class InsightResult:
    context: DataFrame
    compact: DataFrame


def prepare_insight(feedback: DataFrame, filters: Mapping | None = None, by: Sequence[str] = (), *,
                    max_characters: int = DEFAULT_BUDGET, **options) -> InsightResult:
    """Full and compact contexts of the filtered feedback: one per segment of ``by``, or one in all."""
    rows = context_rows(apply_filters(feedback, filters), by, **options)
    return InsightResult(assemble(rows, by), compact_insight_context(rows, by, max_characters=max_characters))


