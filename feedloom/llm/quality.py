"""Quality of documents by weak supervision: rules vote or abstain, and their votes are combined by a learned model.

One pass measures every whole text. Eleven rules each vote good, bad or nothing. The votes of all documents are counted per
pattern (at most 3^11 patterns, whatever the corpus), expectation-maximisation estimates from the counts how often each rule
is right for good and for bad documents, and the posterior probability of being good is then a sum of weights per vote, which
is a plain column expression. No label is used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import fresh, store, text_buffer
from feedloom.llm.hashing import windows, words

#: Measures of a text, all long.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_marks", "n_plain_words", "n_distinct", "n_top",
)
WINDOW = 8
ROUNDS = 100
_SYMBOL, _LETTER, _UPPER, _MARK = (np.zeros(256, dtype=bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True  # first bytes of longer characters count as letters
_UPPER[65:91] = True
_MARK[list(b"!?")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?\"')(-\x80\x99\xe2")] = True  # among them the bytes of typographic quotes
_FIRST = (np.arange(256) & 0xC0) != 0x80


def _measure(column: pa.Array) -> list[np.ndarray]:
    data, offsets = text_buffer(column)
    found = words(data, offsets)
    n = len(column)

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def per_word(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        return sums[found.end] - sums[found.start]

    def summed(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[found.first[1:]] - sums[found.first[:-1]]

    grams = windows(found.hash, WINDOW)
    out = {name: np.zeros(n, np.int64) for name in MEASURES}
    out["n_words"] = np.diff(found.first).astype(np.int64)
    out["word_chars"] = summed(per_word(_FIRST))
    out["n_symbols"], out["n_letters"], out["n_upper"], out["n_marks"] = (per_text(m) for m in (_SYMBOL, _LETTER, _UPPER, _MARK))
    # Plain words hold at least two letters per other character, and end in a letter or a stop.
    letters, chars = per_word(_LETTER), per_word(_FIRST)
    last = data[found.end - 1] if len(found.end) else data[:0]
    ends = _LETTER[last] | _STOP[last] | (last >= 128)
    out["n_plain_words"] = summed((letters > 0) & (3 * letters >= 2 * chars) & ends)
    raw = data.tobytes()
    for i in range(n):
        a, b = found.first[i], found.first[i + 1]
        if b == a:
            continue
        seen: set[bytes] = set()
        for line in raw[offsets[i] : offsets[i + 1]].split(b"\n"):
            if line.strip(b" \t\n\v\f\r"):
                out["n_lines"][i] += 1
                if line in seen:
                    out["n_dup_lines"][i] += 1
                seen.add(line)
        _, counts = np.unique(found.hash[a:b], return_counts=True)
        out["n_distinct"][i], out["n_top"][i] = len(counts), counts.max()
        if b - a > WINDOW:
            _, which, counts = np.unique(grams[a : b - WINDOW + 1], return_inverse=True, return_counts=True)
            repeated = np.flatnonzero(counts[which] > 1)
            if len(repeated):
                edge = np.zeros(b - a + 1, np.int64)
                np.add.at(edge, repeated, 1)
                np.add.at(edge, repeated + WINDOW, -1)
                out["n_repeat_words"][i] = int((np.cumsum(edge) > 0).sum())
    return [out[name] for name in MEASURES]


def _measured(text: pa.Array) -> pa.Array:
    at, made = 0, []
    lengths = np.cumsum(np.diff(text_buffer(text)[1]))
    while at < len(text):  # about a MB at a time; a longer text alone, but whole
        stop = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + (1 << 20), side="right")))
        made.append(_measure(text.slice(at, stop - at)))
        at = stop
    columns = [np.concatenate(c) for c in zip(*made)] if made else [np.zeros(0, np.int64)] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], list(MEASURES))


def measures(text: Column) -> Column:
    """Struct of all measures of a text; a null text has zeros."""
    kind = "struct<" + ", ".join(f"{name}: long" for name in MEASURES) + ">"
    return F.arrow_udf(_measured, kind).asNondeterministic()(text.cast("string"))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(m: Column) -> list[Column]:
    """The rules: 1 good, -1 bad, 0 no opinion. Bounds follow published filters of web text; texts of under 20 words say little."""
    n = m["n_words"]
    some = n >= 20

    def share(part: str, whole: str) -> Column:
        return m[part] / F.greatest(m[whole], F.lit(1))

    def rule(value: Column, good: Column, bad: Column) -> Column:
        return _vote(value, some & good, some & bad)

    length = share("word_chars", "n_words")
    symbols, upper, marks = share("n_symbols", "n_words"), share("n_upper", "n_letters"), share("n_marks", "n_words")
    lines, repeats = share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    letters, plain = share("n_letters", "word_chars"), share("n_plain_words", "n_words")
    top, distinct = share("n_top", "n_words"), share("n_distinct", "n_words")
    return [
        _vote(n, n >= 50, n < 20),
        rule(length, (length >= 3) & (length <= 9), (length < 2) | (length > 14)),
        rule(symbols, symbols <= 0.02, symbols > 0.1),
        rule(lines, (lines == 0) & (m["n_lines"] >= 3), lines > 0.5),
        rule(repeats, repeats <= 0.05, repeats > 0.3),
        rule(upper, upper < 0.2, upper > 0.5),
        rule(marks, marks <= 0.02, marks > 0.2),
        rule(letters, letters > 0.9, letters < 0.75),
        rule(plain, plain > 0.85, plain < 0.65),
        rule(top, top < 0.15, (top > 0.25) & (n >= 50)),
        rule(distinct, (distinct > 0.4) & (n <= 5000), (distinct < 0.1) & (n <= 5000)),
    ]


RULES = 11


@dataclass(frozen=True)
class Model:
    """Log-odds of being good: ``prior`` plus the weight of each rule's good or bad vote.

    right and wrong: how often a vote is good on good documents, and bad on bad ones.
    """

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]
    right: tuple[float, ...]
    wrong: tuple[float, ...]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how many documents have each.

    Unknowns: the share of good documents and, per rule, how often it votes good on good and bad on bad documents when it
    votes. Abstentions carry nothing. Starts from rules that are mostly right; each rule has a few imagined votes of that
    kind, so that a rule without votes stays defined.
    """
    good, bad = patterns == 1, patterns == -1
    prior, right, wrong = 0.8, np.full(patterns.shape[1], 0.95), np.full(patterns.shape[1], 0.5)
    weight = counts.astype(float)
    for _ in range(rounds):  # right: P(good vote | good), wrong: P(bad vote | bad)
        odds = np.log(prior / (1 - prior)) + good @ np.log(right / (1 - wrong)) + bad @ np.log((1 - right) / wrong)
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        a, b = weight * p, weight * (1 - p)
        prior = (a.sum() + 8) / (weight.sum() + 10)
        right = ((a[:, None] * good).sum(0) + 9.5) / ((a[:, None] * (good | bad)).sum(0) + 10)
        wrong = ((b[:, None] * bad).sum(0) + 5) / ((b[:, None] * (good | bad)).sum(0) + 10)
    weights = np.log(right / (1 - wrong)), np.log((1 - right) / wrong), right, wrong
    return Model(float(np.log(prior / (1 - prior))), *(tuple(w.tolist()) for w in weights))


def learn(measured: Column, documents: DataFrame) -> Model:
    """The model of all documents, from the number of documents per vote pattern: at most 3^11 rows reach the driver."""
    rows = documents.select(*[v.alias(f"v{i}") for i, v in enumerate(votes(measured))]).groupBy(*[f"v{i}" for i in range(RULES)]).count().collect()
    table = np.array([list(r) for r in sorted(rows)], dtype=np.int64).reshape(-1, RULES + 1)
    return estimate(table[:, :RULES], table[:, RULES])


def probability(measured: Column, model: Model) -> Column:
    """Posterior probability of being good."""
    odds: Column = F.lit(model.prior)
    for vote, good, bad in zip(votes(measured), model.good, model.bad):
        odds = odds + F.when(vote == 1, good).when(vote == -1, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def quality(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, the base measures, base_failed, probability (posterior, of being good), kept.

    kept is false if base_failed, else whether the probability reaches the threshold. A null or empty text has no words and
    fails. Rows are judged one by one: repeated rows and null ids get rows of their own; other columns are not looked at.
    An empty table gives no rows.
    """
    text = F.col(f"`{text_column}`")
    measured = store(documents.select(F.col(f"`{id_column}`").alias("doc_id"), measures(text).alias("m")), "quality")
    m = F.col("m")
    model = learn(m, measured)
    return measured.select(
        "doc_id", *[m[name].alias(name) for name in MEASURES[:5]], base_failed(m).alias("base_failed"), probability(m, model).alias("probability")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))


def keep_good(documents: DataFrame, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that ``quality`` would keep, with their columns.

    The rows are stored together with their measures, so texts are measured once and nothing is shuffled or joined by id.
    """
    own = fresh(documents.columns, "measures")
    m = F.col(own)
    judged = store(documents.withColumn(own, measures(F.col(f"`{text_column}`"))), "measured")
    model = learn(m, judged)
    return judged.where(~base_failed(m) & (probability(m, model) >= threshold)).drop(own)

