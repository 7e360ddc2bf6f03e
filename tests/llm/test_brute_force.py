"""Whole operators against plain Python: language profiles, the mix of sources, and the posterior of the quality rules."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from feedloom.llm.language import LISTED, PROFILE, identify_languages
from feedloom.llm.mixing import mix_rows
from feedloom.llm.quality import ROUNDS, RULES, measures, quality, votes

SF = "/root/testdata/sf0.01"


def ngrams(text):
    """Letters in runs of one to three; words stand between single blanks."""
    plain = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    plain = " " + " ".join(plain.split()) + " "
    out = Counter()
    for width in (1, 2, 3):
        for i in range(len(plain) - width + 1):
            gram = plain[i : i + width]
            if gram.strip() and not (width == 3 and gram[1] == " "):
                out[gram] += 1
    return out


def ranked(counts, size):
    """Most frequent first; ties by the code points, read as a number."""
    def number(gram):
        return sum(ord(c) << 21 * i for i, c in enumerate(reversed(gram)))

    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:size]


def nearest(text, profiles):
    listed = ranked(ngrams(text), LISTED)
    if not listed:
        return "und", 0.0
    far = {}
    for lang, profile in profiles.items():
        place = {g: i for i, g in enumerate(profile)}
        far[lang] = sum(abs(place[g] - i) if g in place else PROFILE for i, g in enumerate(listed)) / (PROFILE * len(listed))
    first = min(sorted(far), key=far.get)
    rest = min(d for lang, d in far.items() if lang != first)
    return first, max(0.0, min(1.0, (rest - far[first]) / max(rest, 1e-12)))


ODD = [(10_001, None, "fr"), (10_002, "", "de"), (10_003, "123 -- 4", None), (10_004, "Straße ÄÖ\nü", None), (10_005, "a", "en"), (10_006, "Привет мир", "ru"), (10_007, "x " * 40_000, None)]


def test_languages_equal_plain_profiles(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in documents.where("doc_id < 500").collect()] + ODD
    counts = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if lang is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            counts[lang].update(ngrams(text))
    profiles = {lang: ranked(c, PROFILE) for lang, c in counts.items() if c}
    got = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        lang, score = nearest(text, profiles)
        assert (got[doc_id].lang_pred, got[doc_id].score) == (lang, pytest.approx(score)), doc_id


def plain_exponent(tokens, entropy, repetitions):
    """Scan and bisection over the same two conditions, one number at a time."""
    total = sum(tokens.values())

    def measure(e):
        power = {s: (t / total) ** e for s, t in tokens.items()}
        z = sum(power.values())
        flat = -sum(p / z * math.log(p / z) for p in power.values()) / math.log(len(tokens))
        per_token = [power[s] / tokens[s] for s in tokens]
        return flat, max(per_token) / min(per_token)

    def last(fits):
        low, high = 0.0, 1.0
        if fits(1.0):
            return 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if fits(middle) else (low, middle)
        return low

    return max(last(lambda e: measure(e)[0] >= entropy), last(lambda e: measure(e)[1] > repetitions))


@pytest.mark.parametrize(("entropy", "repetitions", "budget"), [(0.9, 3.0, 5_000), (0.97, 50.0, 9_001), (0.2, 9.0, 700), (1.0, 1.5, 20_000)])
def test_the_mix_equals_a_plain_draw(spark, entropy, repetitions, budget):
    sizes = {"a": 300, "b": 90, "c": 31, None: 8}
    rows = [(1000 * k + i, "x" * (i * 7 % 61 + 1), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sorted((r.doc_id, r.mix_epoch) for r in mix_rows(frame, entropy=entropy, repetitions=repetitions, budget=float(budget), block_tokens=150).collect())

    def weight(text):
        return max(1, math.ceil(len(text) / 4))

    tokens = {s: sum(weight(t) for _, t, own in rows if own == s) for s in sizes}
    exponent = plain_exponent(tokens, entropy, repetitions)
    power = {s: t**exponent for s, t in tokens.items()}
    expected = []
    for s in sizes:
        epochs = power[s] / sum(power.values()) * budget / tokens[s]
        whole = math.floor(epochs + 1e-9)
        own = [(d, t) for d, t, name in rows if name == s]
        expected += [(d, e) for d, _ in own for e in range(whole)]
        left = (epochs - whole) * tokens[s]
        order = frame.where(F.col("source").eqNullSafe(s)).select("doc_id", "text", F.shiftrightunsigned(F.xxhash64(F.lit(0), F.lit(whole), F.xxhash64("doc_id", "text")), 2).alias("h"))
        used = 0
        for r in sorted(order.collect(), key=lambda r: r.h):
            if used < left - 1e-6:
                expected.append((r.doc_id, whole))
            used += weight(r.text)
    assert got == sorted(expected)


def test_posteriors_equal_a_plain_expectation_maximisation(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    cast = documents.select("doc_id", measures(F.col("text")).alias("m"))
    cast = [(r[0], tuple(r[1:])) for r in cast.select("doc_id", *votes(F.col("m"))).collect()]
    prior, right, wrong = 0.8, [0.95] * RULES, [0.5] * RULES

    def log_odds(vote):
        odds = math.log(prior / (1 - prior))
        for v, r, w in zip(vote, right, wrong):
            odds += math.log(r / (1 - w)) if v == 1 else math.log((1 - r) / w) if v == -1 else 0.0
        return odds

    kinds = Counter(vote for _, vote in cast)
    for _ in range(ROUNDS):
        sure = {vote: n / (1 + math.exp(-max(-500.0, min(500.0, log_odds(vote))))) for vote, n in kinds.items()}
        prior = (sum(sure.values()) + 8) / (len(cast) + 10)
        agree = [(sum(p for vote, p in sure.items() if vote[i] == 1), sum(p for vote, p in sure.items() if vote[i])) for i in range(RULES)]
        reject = [(sum(n - sure[vote] for vote, n in kinds.items() if vote[i] == -1), sum(n - sure[vote] for vote, n in kinds.items() if vote[i])) for i in range(RULES)]
        right, wrong = [(a + 9.5) / (b + 10) for a, b in agree], [(a + 5) / (b + 10) for a, b in reject]
    got = {r.doc_id: r for r in quality(documents).collect()}
    assert len(got) == len(cast)
    for doc_id, vote in cast:
        p = 1 / (1 + math.exp(-log_odds(vote)))
        assert got[doc_id].probability == pytest.approx(p, abs=1e-9)
        assert got[doc_id].kept == (p >= 0.5 and not got[doc_id].base_failed)
