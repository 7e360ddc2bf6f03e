"""The row-wise stages over an unbounded source. The analytics themselves are batch."""

from feedloom.streaming.enrichment import stream_enriched

__all__ = ["stream_enriched"]
