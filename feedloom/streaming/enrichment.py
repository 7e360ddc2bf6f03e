"""Enrichment of arriving feedback files. Enrichment has no state, so the batch operators run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.signals import enrich
from feedloom.vocab import Lexicon, RequestRules, ThemeRules


def stream_enriched(clean: DataFrame, output: str, checkpoint: str, *, lexicon: Lexicon | None = None,
                    requests: RequestRules | None = None, themes: ThemeRules | None = None) -> StreamingQuery:
    """Start enriching a streaming frame of clean feedback into Parquet, processing what is there and stopping.

    Files already processed are skipped through the checkpoint.
    """
    if not clean.isStreaming:
        raise ValueError("Pass a streaming frame.")
    enriched = enrich(clean, lexicon=lexicon, requests=requests, themes=themes)
    return (
        enriched.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
