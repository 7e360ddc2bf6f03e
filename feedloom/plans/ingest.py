"""Source table to canonical clean feedback and its audit."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from feedloom.operators.cleaning import ROW, cleaned, cleaning_report, flag_rows
from feedloom.operators.conform import number_rows


@dataclass(frozen=True)
class IngestResult:
    dataframe: DataFrame
    report: DataFrame


def ingest(source: DataFrame, mapping: Mapping[str, str | None] | None = None, *, order_by: str | None = None,
           normalise: bool = True) -> IngestResult:
    """Dedupe, map, type and clean a source table. Both results are lazy and share one shuffle when persisted.

    Row order comes from ``source_row_number`` (the CSV reader adds it) or from the unique column ``order_by``, which
    is left out of the duplicate comparison.
    """
    if ROW not in source.columns:
        if order_by is None:
            raise ValueError(f"Give {ROW} or name a unique order_by column.")
        source = number_rows(source, order_by).drop(order_by)
    flagged = flag_rows(source, mapping, normalise=normalise)
    return IngestResult(cleaned(flagged), cleaning_report(flagged))
