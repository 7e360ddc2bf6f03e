"""Feature-request detection: request wording gates a scored match against request groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.search import find_terms, literal_table
from feedloom.functions.text import request_text
from feedloom.operators.grouping import computed_once
from feedloom.vocab import requests as vocab
from feedloom.vocab.requests import RequestRules

OUTPUT = (
    "is_feature_request", "feature_request_detected", "feature_request_text", "feature_request_confidence",
    "feature_request_group", "feature_request_method", "feature_request_matched_terms", "feature_request_score",
)
HITS = "_request_hits"
_SEP, _START = "\x1f", "\x02"
# Kinds of hit: points for a group, a bar on a group, and the wording that gates the whole text.
_SCORED, _BARS, _COMPLAINT, _INTENT, _FALLBACK = range(5)


class _Index:
    """Search terms of a rule table and what each hit means."""

    def __init__(self, rules: RequestRules):
        self.terms: list[str] = []
        self.places: dict[str, int] = {}
        self.entries: list[list[tuple]] = []
        self.combinations: list[dict] = []
        self.groups = [r.group for r in rules.rules]
        self.priorities = [r.priority for r in rules.rules]
        for g, rule in enumerate(rules.rules):
            order = 0
            for phrase in rule.phrases:
                points = vocab.PHRASE_POINTS if " " in phrase else vocab.WORD_POINTS
                self._add(phrase, (g, _SCORED, points, order, phrase))
                order += 1
            for keyword in rule.keywords:
                self._add(_SEP + keyword + _SEP, (g, _SCORED, vocab.KEYWORD_POINTS, order, keyword))
                order += 1
            for parts in rule.combinations:
                members = [self._add(p, None) for p in parts]
                entry = {
                    "group": g, "kind": _SCORED, "points": vocab.COMBINATION_POINTS, "position": order,
                    "term": " + ".join(parts),
                }
                self.combinations.append({"entry": entry, "members": members})
                order += 1
            for exclusion in rule.exclusions:
                self._add(exclusion, (g, _BARS, 0, 0, exclusion))
        for kind, phrases in (
            (_COMPLAINT, vocab.COMPLAINT_PHRASES), (_INTENT, vocab.INTENT_PHRASES), (_FALLBACK, vocab.FALLBACK_PHRASES),
        ):
            for phrase in phrases:
                self._add(_whole(phrase), (-1, kind, 0, 0, phrase))
        for opening in (*vocab.IMPERATIVE_VERBS, "need", "i need"):
            self._add(_START + _whole(opening), (-1, _INTENT, 0, 0, opening))

    def _add(self, term: str, entry: tuple | None) -> int:
        position = self.places.setdefault(term, len(self.terms))
        if position == len(self.terms):
            self.terms.append(term)
            self.entries.append([])
        if entry is not None:
            self.entries[position].append(entry)
        return position


def _whole(words: str) -> str:
    """A run of whole words as it appears in the token copy of a text."""
    return _SEP + words.replace(" ", _SEP) + _SEP


def add_request_signals(df: DataFrame, rules: RequestRules, *, normalise: bool = True) -> DataFrame:
    """Add the rule terms and request wording found in each text.

    The searched text is the normalised text followed by a copy with separators for spaces, where whole words,
    whole phrases and the opening words can be found as substrings.
    """
    text = request_text(F.coalesce(F.col("clean_text"), F.lit("")), normalise)
    searched = F.concat(text, F.lit(_START + _SEP), F.replace(text, F.lit(" "), F.lit(_SEP)), F.lit(_SEP))
    return df.withColumn(HITS, find_terms(searched, _Index(rules).terms))


def add_feature_request_columns(df: DataFrame, rules: RequestRules | None = None, *, normalise: bool = True) -> DataFrame:
    """Add the eight feature_request columns. Map-only: one search per text, then expressions over its few hits.

    Uses the signal column if the frame has it, see ``feedloom.operators.signals``.
    """
    rules = rules or RequestRules.default()
    index = _Index(rules)
    base = [c for c in df.columns if c not in (*OUTPUT, HITS)]
    staged = df if HITS in df.columns else add_request_signals(df, rules, normalise=normalise)
    fields = ("group", "kind", "points", "position", "term")
    entry = "struct<group:int,kind:int,points:int,position:int,term:string>"
    table = literal_table([[dict(zip(fields, e, strict=True)) for e in es] for es in index.entries], f"array<{entry}>")
    entries = F.flatten(F.transform(HITS, lambda i: F.get(table, i)))
    combos = literal_table(index.combinations, f"struct<entry:{entry},members:array<int>>")
    complete = F.filter(combos, lambda c: F.size(F.array_except(c["members"], F.col(HITS))) == 0)
    combo_entries = F.transform(complete, lambda c: c["entry"])
    staged = staged.withColumn("_entries", F.concat(entries, combo_entries) if index.combinations else entries)

    def has(kind: int) -> Column:
        return F.exists("_entries", lambda e: e["kind"] == kind)

    gate = F.when(has(_COMPLAINT), F.lit(None)).when(has(_INTENT), _INTENT).when(has(_FALLBACK), _FALLBACK)
    barred = F.transform(F.filter("_entries", lambda e: e["kind"] == _BARS), lambda e: e["group"])
    staged = staged.withColumns({"_gate": gate, "_fallback": has(_FALLBACK), "_barred": F.when(gate.isNotNull(), barred)})
    points = F.filter(
        "_entries", lambda e: (e["kind"] == _SCORED) & ~F.array_contains(F.col("_barred"), e["group"])
    )
    staged = staged.withColumn("_points", F.when(F.col("_gate").isNotNull(), points))
    priorities = literal_table([-p for p in index.priorities], "int")
    found = F.array_distinct(F.transform("_points", lambda e: e["group"]))
    scores = F.transform(found, lambda g: F.struct(
        F.aggregate(
            F.filter("_points", lambda e: e["group"] == g), F.lit(0), lambda acc, e: acc + e["points"]
        ).alias("score"),
        F.get(priorities, g).alias("rank"),
        g.alias("group"),
    ))
    staged = staged.withColumn("_scores", scores)
    best = F.array_max("_scores")
    if vocab.PREFERRED_GROUP in index.groups:
        preferred = F.get(F.filter(
            "_scores",
            lambda s: (s["group"] == index.groups.index(vocab.PREFERRED_GROUP)) & (s["score"] >= vocab.PHRASE_POINTS),
        ), F.lit(0))
        best = F.coalesce(preferred, best)
    staged = staged.withColumn("_best", F.when(F.col("_gate") == _INTENT, best))
    best = F.col("_best")
    is_fallback = F.col("_gate").isNotNull() & F.col("_fallback") & (F.size("_scores") == 0)
    kind = F.when(best.isNotNull(), "taxonomy_phrase").when(is_fallback, "intent_fallback").otherwise("no_request_intent")
    staged = staged.withColumn("feature_request_method", kind)
    scored = F.col("feature_request_method") == "taxonomy_phrase"
    fallback = F.col("feature_request_method") == "intent_fallback"
    detected = scored | fallback
    group = F.get(literal_table(index.groups, "string"), best["group"])
    step = F.lit(vocab.LOWEST_CONFIDENCE)
    for at, confidence in reversed(vocab.CONFIDENCE_STEPS):
        step = F.when(best["score"] >= at, confidence).otherwise(step)
    own = F.array_sort(F.transform(
        F.filter("_points", lambda e: e["group"] == best["group"]),
        lambda e: F.struct(e["position"].alias("position"), e["term"].alias("term")),
    ))
    terms = F.array_join(F.array_distinct(F.transform(own, lambda e: e["term"])), ", ")
    return computed_once(staged, base, [
        detected.alias("is_feature_request"),
        detected.alias("feature_request_detected"),
        F.when(scored, group).when(fallback, vocab.OTHER_TEXT).alias("feature_request_text"),
        F.when(scored, step).when(fallback, vocab.FALLBACK_CONFIDENCE).otherwise(0.0).alias("feature_request_confidence"),
        F.when(scored, group).when(fallback, vocab.OTHER_GROUP).alias("feature_request_group"),
        F.col("feature_request_method"),
        F.when(scored, terms).alias("feature_request_matched_terms"),
        F.when(scored, best["score"].cast("double")).otherwise(0.0).alias("feature_request_score"),
    ])
