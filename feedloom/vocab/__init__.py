"""Reference data: rule tables, risk tables, lexicon and column aliases, all replaceable by the caller."""

from feedloom.vocab.lexicon import Lexicon
from feedloom.vocab.requests import RequestRules
from feedloom.vocab.themes import ThemeRules

__all__ = ["Lexicon", "RequestRules", "ThemeRules"]
