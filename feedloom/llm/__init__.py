"""Operators of a training-data pipeline: deduplication, tokens, chat text, URL, mixing, language, privacy, toxicity, quality."""
