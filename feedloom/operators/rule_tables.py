"""Theme rules of any number, as a table: which terms of it occur in which texts, by whole words and by the ends of words.

``themes.match_rules`` ships its rules inside the plan, which suits hundreds of terms. Here rules stay a table. A term that is
one word meets the words of the texts. A term with a space or hyphen is entered under one of its separators with the ends of
the words beside it, the one that fewest terms have; a text probes with all its separators, and only texts that hold the
entry of a term are tested for the term. A Bloom filter leaves out words and probes that no term has before they are
shuffled. No rule is collected, and the joins are Spark's to choose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bloom import maybe_in
from feedloom.functions.text import WORD, nonblank, rule_text
from feedloom.operators.grouping import computed_once, top_per_group
from feedloom.operators.themes import KEYWORD_POINTS, PHRASE_POINTS
from feedloom.session import materialize

#: Characters of the word before and after a separator that an entry may hold: of each word the most that it has.
ENDS = (8, 3, 1, 0)
#: Rows of a table that is small enough for Spark to send it to all tasks: nothing is shuffled then, and a filter only costs.
SMALL = 100_000
_PRINT = "_print"


def _ahead_of_join(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that may have a partner; all of them if the join with so few does not shuffle."""
    return df if wanted.limit(SMALL + 1).count() <= SMALL else maybe_in(df, _PRINT, wanted)


def _beside(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, before, after: the words before and after every space and hyphen of a text, each with the separator behind it."""
    pieces = computed_once(df, [key], [F.split(column, "(?<=[ -])", -1).alias("_pieces")])
    rest = F.size("_pieces") - 1
    return pieces.select(key, F.inline(F.arrays_zip(F.slice("_pieces", 1, rest), F.slice("_pieces", 2, rest)))).toDF(key, "before", "after")


def _entry(ends: tuple[int, int] | tuple[Column, Column]) -> Column:
    """Hash of a separator with so many characters before and after it."""
    before, after = (F.lit(e) if isinstance(e, int) else e for e in ends)
    return F.xxhash64(F.concat(F.substring("before", -(before + 1), before + 1), F.lit("\0"), F.substring("after", F.lit(1), after)))


def _longest(length: Column) -> Column:
    return reduce(lambda longer, n: F.when(length >= n, n).otherwise(longer), sorted(ENDS)[1:], F.lit(0))


def _is_phrase(term: Column) -> Column:
    return term.rlike("[ -]")


def rule_terms(rules: DataFrame) -> DataFrame:
    """Distinct terms of (rule_idx, phrases, keywords): rule_idx, points, by_phrase, needle.

    A term with a space or hyphen is found anywhere in a text, another one as a whole word.
    """
    def listed(column: str, points: float, phrase: int) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda t: F.struct(t.alias("needle"), F.lit(points).alias("points"), F.lit(phrase).alias("by_phrase")))

    terms = rules.select("rule_idx", F.explode(F.concat(listed("phrases", PHRASE_POINTS, 1), listed("keywords", KEYWORD_POINTS, 0))).alias("t")).select("rule_idx", "t.*")
    return terms.where(nonblank(F.col("needle"))).groupBy("rule_idx", "needle", "by_phrase").agg(F.sum("points").alias("points"))


def _words_found(texts: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """key, needle for the terms that are words of a text."""
    spoken = texts.select(key, F.explode(F.array_distinct(F.split("_text", f"[^{WORD}]+"))).alias("needle")).withColumn(_PRINT, F.xxhash64("needle"))
    return _ahead_of_join(spoken, words.select(F.xxhash64("needle").alias(_PRINT))).drop(_PRINT).join(words, "needle", "left_semi").select(key, "needle")


def _entries(phrases: DataFrame) -> DataFrame:
    """needle, hash, ends: of the separators of each needle the one whose entry fewest needles have, ties to the smaller."""
    ends = (_longest(F.length("before") - 1), _longest(F.length(F.regexp_replace("after", "[ -]$", ""))))
    every = _beside(phrases.select("needle", F.col("needle").alias("_text")), "_text", "needle").select("needle", _entry(ends).alias(_PRINT), F.struct(ends[0].alias("before"), ends[1].alias("after")).alias("ends")).distinct()
    shared = every.groupBy(_PRINT).agg(F.countDistinct("needle").alias("needles"))
    rarest = every.join(shared, _PRINT).groupBy("needle").agg(F.min(F.struct("needles", _PRINT, "ends")).alias("e"))
    return rarest.select("needle", f"e.{_PRINT}", "e.ends")


def _phrases_found(texts: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """key, needle for the terms that a text holds anywhere."""
    entries = materialize(_entries(phrases))
    # A few pairs of lengths, whatever the number of terms.
    kinds = [(r["before"], r["after"]) for r in entries.select("ends.*").distinct().collect()]
    pairs = _beside(texts, "_text", key)
    probes = F.array(*[F.when((F.length("before") > b) & (F.length("after") >= a), _entry((b, a))) for b, a in kinds]).cast("array<bigint>")
    probed = pairs.select(key, F.explode(probes).alias(_PRINT)).where(F.col(_PRINT).isNotNull())
    entered = entries.select("needle", _PRINT)
    # Narrow rows meet first; the text is fetched for the candidates only.
    candidates = _ahead_of_join(probed, entered.select(_PRINT).distinct()).join(entered, _PRINT).select(key, "needle").distinct()
    return candidates.join(texts, key).where(F.col("_text").contains(F.col("needle"))).select(key, "needle")


def term_matches(texts: DataFrame, terms: DataFrame, key: str, text_column: str = "clean_text") -> DataFrame:
    """key and the rows of ``terms`` for every term that occurs in a text. Keys are unique."""
    text = F.col(text_column)
    # Read three times: for words, for probes and for the candidates.
    low = materialize(computed_once(texts.where(nonblank(text)), [key], [rule_text(text).alias("_text")]))
    needles = materialize(terms.select("needle", _is_phrase(F.col("needle")).alias("_phrase")).distinct())
    words, phrases = (needles.where(kind).select("needle") for kind in (~F.col("_phrase"), F.col("_phrase")))
    return _words_found(low, words, key).unionByName(_phrases_found(low, phrases, key)).join(terms, "needle")


def match_rule_table(texts: DataFrame, rules: DataFrame, key: str, text_column: str = "clean_text") -> DataFrame:
    """Per text with a match: key, theme, subtheme, score, by_phrase, secondary (best other theme).

    ``rules`` has rule_idx, theme, subtheme, phrases, keywords. The highest score wins, ties go to the earlier rule. Texts
    without a match, blank and null ones are left out. Terms of any length are found.
    """
    terms = rule_terms(rules).join(rules.select("rule_idx", "theme", "subtheme"), "rule_idx")
    # Dealt by text once; the groups below are parts of a text's rows.
    matches = term_matches(texts, terms, key, text_column).repartition(F.col(key))
    named = matches.groupBy(key, "rule_idx", "theme", "subtheme").agg(F.sum("points").alias("score"), (F.max("by_phrase") > 0).alias("by_phrase"))
    # The best rule of each theme, then the best two themes: a text has few of either.
    themes = named.groupBy(key, "theme").agg(F.max(F.struct("score", (-F.col("rule_idx")).alias("order"), "subtheme", "by_phrase")).alias("best"))
    ranked = top_per_group(themes, [key], [F.desc("best.score"), F.desc("best.order")], 2, "_rank")
    first = F.col("_rank") == 1
    return ranked.groupBy(key).agg(
        *[F.max(F.when(first, c)).alias(n) for n, c in (("theme", F.col("theme")), ("subtheme", F.col("best.subtheme")), ("score", F.col("best.score")), ("by_phrase", F.col("best.by_phrase")))],
        F.max(F.when(~first, F.col("theme"))).alias("secondary"),
    )
