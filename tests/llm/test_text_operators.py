"""Quality rules, language identification, toxicity and URL filter: brute force, planted cases, held-out accuracy, edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import urls
from feedloom.llm.language import identify_languages
from feedloom.llm.quality import estimate, keep_good, quality
from feedloom.llm.toxicity import build_index, learn, toxicity
from feedloom.llm.urls import filter_urls

SF = "/root/testdata/sf0.01"
EMPTY = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def base_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


ODD = [
    None, "", " \n \t\n", "one", "é\x0bü\x0c# $", "a b\n\na b\na b \na b", " ".join(["x y z"] * 40), "same line\n" * 30, "w " * 100_000,
    " ".join(f"w{i}" for i in range(60_000)), "no-break space　wide", " ".join(f"u{i % 37}" for i in range(200)), "<|>&%$*#" * 30,
]


def test_base_measures_equal_brute_force(spark, documents):
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(i, t, 5, "m") for i, t in texts], "doc_id long, text string, n_words int, measures string")
    got = {r.doc_id: r for r in quality(frame).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(text), (i, (text or "")[:80])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in keep_good(frame).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_quality_keeps_good_documents_and_finds_bad_ones(documents, labels):
    rows = quality(documents).join(labels, "doc_id").select("quality", "base_failed", "kept").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.98
    assert sum(not r.kept for r in bad) / len(bad) > 0.9


def test_expectation_maximisation_finds_the_accuracies():
    """Votes drawn from known accuracies give the accuracies back."""
    rng = np.random.default_rng(8)
    right, wrong = np.array([0.95, 0.9, 0.99, 0.97]), np.array([0.8, 0.6, 0.9, 0.4])
    good = rng.random(40_000) < 0.8
    votes = np.where(good[:, None], np.where(rng.random((40_000, 4)) < right, 1, -1), np.where(rng.random((40_000, 4)) < wrong, -1, 1))
    votes[rng.random((40_000, 4)) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = estimate(patterns, counts, rounds=500)
    assert np.allclose(model.right, right, atol=0.02) and np.allclose(model.wrong, wrong, atol=0.04)
    assert abs(1 / (1 + np.exp(-model.prior)) - 0.8) < 0.02


def test_quality_of_nothing(spark):
    empty = spark.createDataFrame([], EMPTY)
    assert quality(empty).collect() == [] and keep_good(empty).collect() == []
    assert [r.kept for r in quality(spark.createDataFrame([(None, None, None)], EMPTY)).collect()] == [False]


def test_languages_of_held_out_documents(documents):
    rows = identify_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_does_not_depend_on_neighbours_or_labels(spark, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.limit(300).collect()]
    extra = [(None, "The and of that with from", None), (None, None, "en"), (7001, "123 !? ", "fr"), (7002, "", "de"), (7003, rows[0][1] * 200, None)]
    frame = spark.createDataFrame(rows + extra, EMPTY)
    one = {(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in identify_languages(frame.repartition(1)).collect()}
    many = {(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in identify_languages(frame.repartition(7)).collect()}
    assert one == many
    assert {p for i, _, p, _ in one if i in (7001, 7002)} == {"und"}
    assert (None, False, "und", 0.0) in one
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify_languages(unlabelled).collect()} == {"und"}
    assert identify_languages(spark.createDataFrame([], EMPTY)).collect() == []


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(6)
    examples = [(i, int(rng.random() < 0.4), {int(t): int(rng.integers(1, 5)) for t in rng.choice(30, rng.integers(0, 8), replace=False)}, int(rng.integers(0, 50))) for i in range(500)]
    index = build_index(rng.uniform(1, 6, 30), examples)
    full = np.zeros((500, 31))
    for row, (_, _, counts, rest) in zip(full, examples):
        which, weight = index.vector(counts, rest)
        row[which] = weight
    for query in range(0, 500, 7):
        which, weight = index.vector(*examples[query][2:])
        cosines = full[:, which] @ weight
        _, got = index.nearest(which, weight, without=query)
        cosines[query] = 0
        assert np.allclose(got, [c for c in sorted(cosines, reverse=True)[: len(got)]], atol=1e-8)
        # The fifteen nearest, and all that are as near as the last of them.
        last = sorted(cosines, reverse=True)[14]
        assert len(got) == int((cosines >= max(last - 1e-9, 1e-12)).sum())


def test_clean_texts_are_not_judged_by_the_order_of_the_table(spark):
    """Toxic words too rare to be terms: texts without a term tie with all examples without one, and stay unflagged."""
    rng = np.random.default_rng(9)
    common, rare = [f"w{i}" for i in range(300)], [f"bad{'abcdefghij'[i]}x" for i in range(10)]
    rows = []
    for i in range(600):
        words = list(rng.choice(common, 40))
        toxic = int(i % 6 == 0)
        rows.append((i, " ".join(words + ([rare[i % 10]] if toxic else [])), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity(frame.drop("toxic"), frame.select("doc_id", "toxic")).join(frame.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    clean = [r for r in got if not r.toxic]
    assert len(clean) > 100 and not any(r.predicted for r in clean)


def test_toxic_documents_are_found(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(documents, labels).join(labels, "doc_id").where("held_out").collect()
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    toxic, clean = ([r.predicted for r in rows if r.toxic == t] for t in (1, 0))
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.01


def test_toxicity_uses_no_held_out_label(documents, labels):
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity(documents, table).collect()} for table in (labels, flipped))
    assert a == b and len(a) == documents.count()


def test_toxicity_of_odd_rows(spark, labels):
    rows = [(None, None, "x"), (1, "", "x"), (1, "again", "x"), (2, "idiot " * 50_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    got = toxicity(frame, labels.limit(0)).collect()
    assert len(got) == 4 and all(r.score == 0 and r.predicted == 0 for r in got)
    own = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (2, 0), (3, None), (9, 5)], "doc_id long, toxic int")
    assert len(toxicity(frame, own, held_out=(1, 9)).collect()) == 4
    assert toxicity(frame.limit(0), labels).collect() == []


def test_only_copies_of_one_label_count_once(spark):
    """Texts with the same least word hashes, and equal texts of the two labels, all stay examples."""
    shared = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one"
    rows = [(i, f"{shared} {'foul' if i % 2 else 'fine'} w{chr(97 + i % 26)}{chr(97 + i // 26)}x", i % 2) for i in range(60)]
    rows += [(100, "The  same\nfoul text", 1), (101, "the same foul text", 1), (102, "the same foul text", 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    scorer = learn(documents.select("doc_id", "text"), documents.select("doc_id", "toxic"), held_out=(1, 9))
    assert sorted(scorer.index.ids.tolist()) == [*range(60), 100, 102]


def rare_words(spark, each, n=1500):
    """Toxic examples hold one of many words, each in ``each`` of n; unlabelled documents, 60 toxic and 60 clean ones."""
    rng = np.random.default_rng(4)
    plain = ["p" + "".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    foul = [chr(97 + i // 26) + chr(97 + i % 26) + "zq" + "".join(rng.choice(list("abcdefgh"), 4)) for i in range(-(-n // each))]
    text = lambda i, bad: " ".join([*rng.choice(plain, 20), *([foul[i % len(foul)]] if bad else [])])
    rows = [(i, text(i // 2, i % 2), i % 2) for i in range(2 * n)] + [(10_000 + i, text(i // 2, i % 2), None) for i in range(120)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = {r.doc_id - 10_000: r.predicted for r in toxicity(documents, documents.select("doc_id", "toxic"), held_out=(1, 9)).where("doc_id >= 10000").collect()}
    return sum(p for i, p in found.items() if i % 2), sum(p for i, p in found.items() if not i % 2)


def test_toxic_words_that_are_rare_each(spark):
    """Each in 25 of 1500 toxic examples and in no clean one."""
    assert rare_words(spark, 25) == (60, 0)


RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
URLS = {
    "http://a.example.net/en/1?x=/de/": ("a.example.net", "/en/1", "example.net/en/"),
    "https://EXAMPLE.Net/EN/1": ("example.net", "/EN/1", "net/"),
    "http://myexample.net/en/": ("myexample.net", "/en/", "net/"),
    "http://example.com/de/": ("example.com", "/de/", "example.com/de/"),
    "http://example.com/de": ("example.com", "/de", None),
    "http://x.org/fr/#top": ("x.org", "/fr/", "org/fr/"),
    "http://org/fr/a": ("org", "/fr/a", "org/fr/"),
    "http://a.net": ("a.net", "", None),
    "http://a.net?q=/": ("a.net", "", None),
    "a.net/x": ("", "", None),
    "x://y://z/": ("y:", "//z/", None),
    "": ("", "", None),
    None: ("", "", None),
    "http://É.net/ü\n#": ("É.net", "/ü\n", "net/"),
}


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://b.net/", "h")], "page_id long, url string, host string")
    got = {r.page_id: r for r in filter_urls(frame, RULES).collect()}
    assert len(got) == len(URLS) + 1
    for i, want in enumerate(URLS.values()):
        assert (got[i].host, got[i].path, got[i].rule) == want
        if want[2]:
            assert got[i].verdict == dict(RULES)[want[2]]


def test_models_judge_what_no_rule_decides(spark):
    good = [f"http://news.site{i}.org/fr/article-{i}" for i in range(150)]
    bad = [f"http://casino{i}.win.net/bonus/{i}" for i in range(150)]
    asked = {f"http://news.other{i}.com/article-{i}": "allow" for i in range(20)} | {f"http://casino{i}.win.com/bonus/{i}": "block" for i in range(20)}
    frame = spark.createDataFrame([(i, u) for i, u in enumerate([*good, *bad, *asked])], "page_id long, url string").repartition(5)
    got = {r.page_id: r.verdict for r in filter_urls(frame, RULES).collect()}
    assert [got[300 + i] for i in range(40)] == list(asked.values())


def test_likelihoods_equal_brute_force(spark):
    """Scores of a few urls against counts taken directly."""
    seen = [("a.org", "/fr/x"), ("b.org", "/fr/y"), ("c.net", "/z"), ("d.net", "/zz"), ("d.net", "/zz")]
    frame = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate([*seen, ("e.com", "/fr/xy")])], "page_id long, url string")
    got = {r.page_id: r.ratio for r in filter_urls(frame, RULES).collect()}

    def stats(urls_):
        counts = Counter(g for h, p in urls_ for g in urls._grams(h, p))
        after, kinds = Counter(), Counter()
        for gram, n in counts.items():
            after[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        return {g: (counts[g], after[g], kinds[g]) for g in counts.keys() | after.keys()}

    for i, (host, path) in enumerate([*seen, ("e.com", "/fr/xy")]):
        accepted = [u for j, u in enumerate(seen) if j < 2 and j != i]
        rejected = [u for j, u in enumerate(seen) if j >= 2 and j != i]
        text = f"\x02{host}{path}\x03"
        ratio = urls.log_likelihood(text, stats(accepted), None) - urls.log_likelihood(text, stats(rejected), None)
        assert got[i] == pytest.approx(ratio / (len(text) - 1), abs=1e-9)


def test_urls_without_anything_to_learn_are_allowed(spark):
    frame = spark.createDataFrame([(1, "http://a.com/"), (2, None), (2, None)], "page_id long, url string")
    assert [r.verdict for r in filter_urls(frame, RULES).collect()] == ["allow"] * 3
    assert filter_urls(frame.limit(0), RULES).collect() == []
