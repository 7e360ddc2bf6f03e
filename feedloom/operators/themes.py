"""Theme classification: scored rules, then similarity to the rule table, then a fallback."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.search import find_terms_or, literal_table
from feedloom.functions.text import WORD, nonblank, rule_text
from feedloom.operators.grouping import computed_once
from feedloom.vocab.themes import FEATURE_REQUEST, OTHER, POSITIVE_FEEDBACK, ThemeRules

OUTPUT = ("primary_theme", "secondary_theme", "subtheme", "classification_confidence", "classification_method")
HITS, GRAMS, _FOUND = "_theme_hits", "_theme_grams", "_theme_found"
_SEP = "\x1f"
PHRASE_POINTS, KEYWORD_POINTS = 3.0, 1.0
BASE_CONFIDENCE, CONFIDENCE_PER_POINT, CONFIDENCE_LIMIT = 0.62, 0.09, 0.98
SIMILARITY_AT, SIMILARITY_BASE, SIMILARITY_LIMIT = 0.16, 0.35, 0.7


def _needles(terms: list[str]) -> tuple[list[str], list[tuple[int, str]]]:
    """What to search for each term in a text and its token copy, and the patterns of the terms that need one.

    Terms with a space or hyphen are found anywhere, others as whole words.
    """
    plain = re.compile(r"^[\w]+$")
    needles, odd = [], []
    for i, term in enumerate(terms):
        if " " in term or "-" in term:
            needles.append(term)
        elif plain.match(term):
            needles.append(_SEP + term + _SEP)
        else:
            needles.append(_SEP + _SEP + term)
            odd.append((i, _boundary_pattern(term)))
    return needles, odd


def _long_words(searched: str) -> str:
    """The words of two letters and more in the token copy that follows a text."""
    return _SEP + _SEP.join(word for word in searched.partition(_SEP)[2].split(_SEP) if len(word) > 1) + _SEP


def _boundary_pattern(term: str) -> str:
    """Word boundaries around a term that itself holds punctuation."""
    word = re.compile(r"\w")
    start = f"(?<![{WORD}])" if word.match(term[0]) else f"(?<=[{WORD}])"
    end = f"(?![{WORD}])" if word.match(term[-1]) else f"(?=[{WORD}])"
    return start + re.sub(r"([^\w\s])", r"\\\1", term) + end


def rule_terms(rules: ThemeRules) -> tuple[list[str], list[list[tuple]]]:
    """Distinct terms of a rule table, and per term the (rule, points, is_phrase) it contributes."""
    entries: dict[str, list[tuple]] = {}
    for r, rule in enumerate(rules.rules):
        for phrase in rule.phrases:
            entries.setdefault(phrase, []).append((r, PHRASE_POINTS, 1))
        for keyword in rule.keywords:
            entries.setdefault(keyword, []).append((r, KEYWORD_POINTS, 0))
    return list(entries), list(entries.values())


def add_theme_signals(df: DataFrame, rules: ThemeRules) -> DataFrame:
    """Add what the two searches find in each text: rule terms, and vocabulary terms where no rule term occurs."""
    text = F.when(nonblank(F.col("clean_text")), rule_text(F.col("clean_text")))
    # Word tokens follow the text between separators, so one search covers phrases and words.
    searched = F.concat(text, F.lit(_SEP), F.regexp_replace(text, f"[^{WORD}]+", _SEP), F.lit(_SEP))
    needles, odd = _needles(rule_terms(rules)[0])
    grams = [_SEP + _SEP.join(gram) + _SEP for gram in ngram_weights(rules)[0]]
    staged = df.withColumn(_FOUND, find_terms_or(searched, needles, _long_words, grams))
    hits, others = F.col(_FOUND)["hits"], F.col(_FOUND)["others"]
    if odd:
        extra = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(i)) for i, p in odd]))
        hits = F.array_sort(F.array_union(hits, extra))
        others = F.when(F.size(hits) == 0, others)
    return staged.withColumns({HITS: hits, GRAMS: others}).drop(_FOUND)


def match_rules(df: DataFrame, rules: ThemeRules, name: str = "_match") -> DataFrame:
    """Add a struct with the best rule, its score and the runner-up theme; null where nothing matched.

    Best is the highest score, ties go to the earlier rule. Map-only; reads the hits of ``add_theme_signals``.
    """
    _, entries = rule_terms(rules)
    rows = [[{"rule": r, "points": p, "phrase": k} for r, p, k in es] for es in entries]
    table = literal_table(rows, "array<struct<rule:int,points:double,phrase:int>>")
    theme_of = literal_table([r.theme for r in rules.rules], "string")
    subtheme_of = literal_table([r.subtheme for r in rules.rules], "string")
    staged = df.withColumn("_entries", F.flatten(F.transform(HITS, lambda i: F.get(table, i))))
    matched = F.array_distinct(F.transform("_entries", lambda e: e["rule"]))
    scored = F.transform(matched, lambda r: F.aggregate(
        F.filter("_entries", lambda e: e["rule"] == r),
        F.struct(F.lit(0.0).alias("score"), (-r).alias("rank"), F.lit(0).alias("phrases"), F.get(theme_of, r).alias("theme")),
        lambda acc, e: F.struct(
            (acc["score"] + e["points"]).alias("score"), acc["rank"].alias("rank"),
            (acc["phrases"] + e["phrase"]).alias("phrases"), acc["theme"].alias("theme"),
        ),
    ))
    staged = staged.withColumn("_scored", scored).withColumn("_top", F.array_max("_scored"))
    top = F.col("_top")
    other = F.array_max(F.filter("_scored", lambda s: s["theme"] != F.col("_top")["theme"]))
    match = F.when(top.isNotNull(), F.struct(
        top["theme"].alias("theme"),
        F.get(subtheme_of, -top["rank"]).alias("subtheme"),
        top["score"].alias("score"),
        (top["phrases"] > 0).alias("by_phrase"),
        other["theme"].alias("secondary"),
    ))
    return computed_once(staged, df.columns, [match.alias(name)])


def ngram_weights(rules: ThemeRules) -> tuple[list[tuple[str, ...]], list[float], list[list[tuple[int, float]]]]:
    """Vocabulary, inverse document frequency and L2-normalised rule weights of one- and two-word terms.

    The rule table is the whole corpus: each rule's theme, subtheme, phrases and keywords form one document. It is
    a checked-size parameter, so the weights are built once on the driver.
    """
    documents = []
    for rule in rules.rules:
        text = " ".join((rule.theme, rule.subtheme, *rule.phrases, *rule.keywords)).lower()
        tokens = re.findall(r"\w\w+", text)
        documents.append(Counter([(t,) for t in tokens] + list(zip(tokens, tokens[1:], strict=False))))
    vocabulary = sorted({gram for d in documents for gram in d})
    frequency = Counter(gram for d in documents for gram in d)
    idf = [math.log((1 + len(documents)) / (1 + frequency[g])) + 1 for g in vocabulary]
    position = {g: i for i, g in enumerate(vocabulary)}
    postings: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
    for r, document in enumerate(documents):
        raw = {position[g]: (1 + math.log(n)) * idf[position[g]] for g, n in document.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        for i, w in raw.items():
            postings[i].append((r, w / norm))
    return vocabulary, idf, postings


def closest_rule(df: DataFrame, rules: ThemeRules, name: str = "_closest") -> DataFrame:
    """Add the rule with the highest cosine similarity to the text (ties to the earlier rule).

    Terms outside the rule vocabulary do not count. Reads the grams of ``add_theme_signals``.
    """
    _, idf, postings = ngram_weights(rules)
    idf_of = literal_table(idf, "double")
    rows = [[{"rule": r, "weight": w} for r, w in p] for p in postings]
    postings_of = literal_table(rows, "array<struct<rule:int,weight:double>>")
    weights = F.transform(F.array_distinct(GRAMS), lambda g: F.struct(
        g.alias("gram"),
        ((F.log(F.size(F.filter(GRAMS, lambda x: x == g)).cast("double")) + 1.0) * F.get(idf_of, g)).alias("weight"),
    ))
    staged = df.withColumn("_weights", weights)
    products = F.flatten(F.transform("_weights", lambda w: F.transform(
        F.get(postings_of, w["gram"]),
        lambda p: F.struct(p["rule"].alias("rule"), (p["weight"] * w["weight"]).alias("part")),
    )))
    length = F.sqrt(F.aggregate("_weights", F.lit(0.0), lambda acc, w: acc + w["weight"] * w["weight"]))
    staged = staged.withColumn("_products", products).withColumn("_length", length)
    similarity = F.transform(F.array_distinct(F.transform("_products", lambda p: p["rule"])), lambda r: F.struct(
        (F.aggregate(
            F.filter("_products", lambda p: p["rule"] == r), F.lit(0.0), lambda acc, p: acc + p["part"]
        ) / F.col("_length")).alias("similarity"),
        (-r).alias("rank"),
    ))
    best = F.array_max(similarity)
    staged = staged.withColumn("_best", best)
    themes = literal_table([r.theme for r in rules.rules], "string")
    subthemes = literal_table([r.subtheme for r in rules.rules], "string")
    closest = F.when(F.col("_best").isNotNull(), F.struct(
        F.get(themes, -F.col("_best")["rank"]).alias("theme"),
        F.get(subthemes, -F.col("_best")["rank"]).alias("subtheme"),
        F.col("_best")["similarity"].alias("similarity"),
    ))
    return computed_once(staged, df.columns, [closest.alias(name)])


def add_classification_columns(df: DataFrame, rules: ThemeRules | None = None) -> DataFrame:
    """Add theme, secondary theme, subtheme, confidence and method.

    Request rows skip the rules, and only rows no rule matched are compared with the rule table. Uses the signal
    columns if the frame has them, see ``feedloom.operators.signals``.
    """
    rules = rules or ThemeRules.default()
    searched = {HITS, GRAMS} <= set(df.columns)
    base = [c for c in df.columns if c not in (*OUTPUT, HITS, GRAMS)]
    is_request = F.coalesce(F.col("is_feature_request"), F.lit(False)) if "is_feature_request" in df.columns else F.lit(False)
    usable = nonblank(F.col("clean_text"))
    staged = df.select(*base, *([HITS, GRAMS] if searched else []))
    staged = closest_rule(match_rules(staged if searched else add_theme_signals(staged, rules), rules), rules)

    match, near = F.col("_match"), F.col("_closest")
    similar = F.coalesce(near["similarity"] >= SIMILARITY_AT, F.lit(False))
    positive = F.col("sentiment").eqNullSafe("Positive") if "sentiment" in df.columns else F.lit(False)
    stage = (
        F.when(is_request, "request")
        .when(~usable, "blank")
        .when(match.isNotNull(), "rule")
        .when(similar, "similar")
        .when(positive, "positive")
        .otherwise("other")
    )
    staged = staged.withColumn("_stage", stage)

    def pick(request, blank, rule, similar, positive, other) -> Column:
        s = F.col("_stage")
        return (
            F.when(s == "request", request).when(s == "blank", blank).when(s == "rule", rule)
            .when(s == "similar", similar).when(s == "positive", positive).otherwise(other)
        )

    has = set(df.columns)
    group = F.col("feature_request_group") if "feature_request_group" in has else F.lit(None).cast("string")
    request_confidence = F.col("feature_request_confidence") if "feature_request_confidence" in has else F.lit(0.0)
    none = F.lit(None).cast("string")
    rule_method = F.when(match["by_phrase"], "rule_exact_phrase").otherwise("rule_keyword")
    rule_confidence = F.least(F.lit(CONFIDENCE_LIMIT), F.lit(BASE_CONFIDENCE) + match["score"] * CONFIDENCE_PER_POINT)
    return computed_once(staged, base, [
        pick(F.lit(FEATURE_REQUEST), F.lit(OTHER), match["theme"], near["theme"], F.lit(POSITIVE_FEEDBACK), F.lit(OTHER))
        .alias("primary_theme"),
        pick(none, none, match["secondary"], none, none, none).alias("secondary_theme"),
        pick(F.coalesce(group, F.lit("Other requested capability")), F.lit("Ambiguous"), match["subtheme"],
             near["subtheme"], F.lit("General praise"), F.lit("Ambiguous")).alias("subtheme"),
        pick(F.greatest(F.lit(0.8), request_confidence), F.lit(0.1), rule_confidence,
             F.least(F.lit(SIMILARITY_LIMIT), near["similarity"] + SIMILARITY_BASE), F.lit(0.55), F.lit(0.2))
        .alias("classification_confidence"),
        pick(F.lit("rule_exact_phrase"), F.lit("fallback_other"), rule_method, F.lit("tfidf_similarity"),
             F.lit("fallback_positive"), F.lit("fallback_other")).alias("classification_method"),
    ])
