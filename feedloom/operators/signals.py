"""Text signals: everything the enrichment stages need Python workers for, computed together.

Spark merges all projections below a Python UDF into that UDF's input, so a UDF stacked on scored columns would
evaluate their expressions again. Computing the searches of all stages first keeps them in one pass over Arrow
batches, with plain expressions above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from feedloom.operators.requests import add_feature_request_columns, add_request_signals
from feedloom.operators.sentiment import add_polarity_signal, add_sentiment_columns
from feedloom.operators.themes import add_classification_columns, add_theme_signals
from feedloom.vocab import Lexicon, RequestRules, ThemeRules


STAGES = ("sentiment", "requests", "themes")


def enrich(df: DataFrame, stages: Sequence[str] = STAGES, *, lexicon: Lexicon | None = None,
           requests: RequestRules | None = None, themes: ThemeRules | None = None, normalise: bool = True) -> DataFrame:
    """Sentiment, then feature requests, then themes, over one set of signals. Map-only.

    Name fewer ``stages`` where not all columns are needed. Themes use sentiment for their last fallback and take over
    request groups, so they want the other two.
    """
    lexicon, requests, themes = lexicon or Lexicon.default(), requests or RequestRules.default(), themes or ThemeRules.default()
    out = df
    if "sentiment" in stages:
        out = add_polarity_signal(out, lexicon)
    if "requests" in stages:
        out = add_request_signals(out, requests, normalise=normalise)
    if "themes" in stages:
        out = add_theme_signals(out, themes)
    if "sentiment" in stages:
        out = add_sentiment_columns(out)
    if "requests" in stages:
        out = add_feature_request_columns(out, requests)
    return add_classification_columns(out, themes) if "themes" in stages else out
