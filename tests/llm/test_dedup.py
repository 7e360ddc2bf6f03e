"""MinHash near dedup and exact dedup against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from feedloom.llm import exact, minhash
from feedloom.llm import hashing
from feedloom.llm.bloom import maybe_in
from feedloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, n long, rep string"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def expected_components(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(120)] for _ in range(12)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6, 9):
            changed = list(words)
            for _ in range(edits):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(999)}"
            texts.append("\t".join(changed).upper() if edits == 2 else " ".join(changed))
    texts += ["", None, " \n\t", "one", "ONE", "one two three", "one two  three", "é È", "É È", "a b c d", "a b c d e"]
    return list(enumerate(texts, start=3))


@pytest.mark.parametrize("width", [4, 5])
def test_components_equal_brute_force(spark, width):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, None, 7, "clash") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame, width).collect()}
    want = expected_components(rows, width)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_misses_in_one_bucket_are_compared_in_blocks(spark, monkeypatch):
    """Many documents of about 0.75: none may be linked, and the linked pair among them must be found."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(200), 9):
            words[at] = f"v{i}_{at}"
        rows.append((i, " ".join(words)))
    rows.append((100, rows[33][1] + " extra words here"))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, 4).collect()}
    assert got == expected_components(rows, 4)
    assert got[100][1] == 33


def test_nulls_repeats_and_empty_tables(spark):
    text = "some words that make up a text of nine"
    frame = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (None, "alone in the world with no id"), (None, None)], "doc_id long, text string")
    got = sorted(minhash.near_duplicates(frame, 4).collect(), key=str)
    assert len(got) == 6
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.n_shingles == 6} == {(None, 5, False), (5, 5, True), (9, 5, False)}
    assert {(r.component_id, r.kept) for r in got if r.n_shingles in (0, 4)} == {(None, True)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == [] and exact.exact_duplicates(empty).collect() == []
    assert minhash.keep_one(empty).collect() == [] and exact.keep_one(empty).collect() == []


def test_a_very_long_text_is_compared_whole(spark):
    words = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:75_000], "other", *words[75_000:]])), (3, " ".join(reversed(words)))]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 1, 3]
    assert got[1].n_shingles == 149_997


def test_estimate_is_close_to_the_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for similarity in (0.5, 0.8, 0.95):
        common = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        own = int(4000 * (1 / similarity - 1) / 2)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, own, dtype=np.uint64)]) for _ in range(2))
        planes = np.stack([minhash.bit_planes(minhash.minima(s, minhash.LONG)) for s in (a, b)]).view(np.uint64)
        one = np.array([0]), np.array([1])
        assert minhash._similar(planes, *one, minhash.LONG, similarity - 0.05)[0]
        assert not minhash._similar(planes, *one, minhash.LONG, similarity + 0.05)[0]


def test_exact_duplicates(spark):
    rows = [(1, "A b"), (7, "a B"), (3, "a b"), (4, "É"), (5, "é"), (6, None), (8, ""), (9, "a b "), (None, "a b"), (2, "x" * 3_000_000), (11, "X" * 3_000_000)]
    frame = spark.createDataFrame([(i, t, None, 0, "s") for i, t in rows], SCHEMA.replace("rep", "fingerprint"))
    got = {r.doc_id: r for r in exact.exact_duplicates(frame).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {
        1: (7, 4, False), 7: (7, 4, True), 3: (7, 4, False), None: (7, 4, False), 4: (4, 1, True), 5: (5, 1, True),
        6: (8, 2, False), 8: (8, 2, True), 9: (9, 1, True), 2: (11, 2, False), 11: (11, 2, True),
    }
    assert got[4].text_sha256 == hashlib.sha256("É".encode()).hexdigest()
    assert sorted(r.doc_id for r in exact.keep_one(frame).collect()) == [4, 5, 7, 8, 9, 11]


def test_repeated_rows_leave_one(spark):
    frame = spark.createDataFrame([(1, "same", "a"), (1, "same", "a"), (1, "same", "b"), (None, "own", "c")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.group_size, r.kept) for r in exact.exact_duplicates(frame).collect()} == {(1, 3, True), (None, 1, True)}
    assert sorted(str(r.doc_id) for r in exact.keep_one(frame).collect()) == ["1", "None"]


def test_equal_fingerprints_of_different_texts_part(spark, monkeypatch):
    """With fingerprints of one byte nearly all texts are routed, and the bytes decide."""
    monkeypatch.setattr(exact, "FINGERPRINT_BITS", 8)
    rows = [(i, f"text {i % 300}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    # Workers import the module afresh, so the filter is tested by itself here.
    prints = [exact._fingerprint(hashlib.sha256(t.encode()).digest()) for _, t in rows]
    assert max(prints) < 256
    counted = {r.fingerprint: r.copies for r in exact.counting_filter(spark.createDataFrame([(p,) for p in prints], "fingerprint long").repartition(5), 600).collect()}
    assert counted == {p: prints.count(p) for p in set(prints)}
    monkeypatch.undo()
    assert {r.group_size for r in exact.exact_duplicates(frame).collect()} == {2}


def test_counting_filter_merges_without_loss(spark):
    rng = random.Random(3)
    prints = [rng.randrange(1 << 48) for _ in range(3000)]
    prints += prints[:500] + [prints[0]] * 2000
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long").repartition(7)
    got = {r.fingerprint: r.copies for r in exact.counting_filter(frame, 1 << 20).collect()}
    assert got == {p: prints.count(p) for p in set(prints)}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 3), (301, 300), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}


def test_bloom_filter_loses_nothing(spark):
    frame = spark.range(5000).select(F.col("id"), F.lit(1).alias("unwanted"))
    wanted = spark.range(0, 5000, 7)
    passed = {r.id for r in maybe_in(frame, "id", wanted).collect()}
    assert set(range(0, 5000, 7)) <= passed and len(passed) < 1200
    narrow = frame.select(F.col("id").cast("int"))
    assert {r.id for r in maybe_in(narrow, "id", wanted).collect()} == passed and {r.id for r in maybe_in(frame, "id", wanted.select(F.col("id").cast("int"))).collect()} == passed
    assert maybe_in(frame, "id", wanted.limit(0)).count() == 0


def test_no_plan_compares_all_pairs(spark):
    plan = minhash.near_duplicates(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_ids_of_other_number_types(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast("int"))
    got = minhash.near_duplicates(frame).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected_components(rows, 5)
    want = {i for i, (_, c) in expected_components(rows, 5).items() if i == c}
    kept = minhash.keep_one(frame)
    assert {r.doc_id for r in kept.collect()} == want and kept.schema["doc_id"].dataType.simpleString() == "int"
    best = {}
    for i, t in rows:
        key = (t or "").encode().lower()
        best[key] = max(i, best.get(key, -1))
    assert {r.doc_id for r in exact.keep_one(frame).collect()} == set(best.values())
    assert all(r.keep_id == best[(t or "").encode().lower()] for r, (_, t) in zip(sorted(exact.exact_duplicates(frame).collect(), key=lambda r: r.doc_id), rows))


def test_a_row_that_repeats_an_id_is_judged_by_its_own_text(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (5, " ".join(words)), (5, "something else that is said only once in here"), (6, "")]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS content", "2 AS d_id"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([rows[0], rows[2], rows[3]]) and kept.columns == ["doc_id", "text", "content", "d_id"]


def test_words_do_not_depend_on_where_they_are_cut(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from feedloom.llm.common import text_buffer

    rng = random.Random(8)
    texts = ["", None, "x" * 500, " " * 300, *(" ".join("ab\ncé"[: rng.randint(1, 6)] * rng.randint(1, 30) for _ in range(rng.randint(0, 90))) for _ in range(40)), "tail"]
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    whole = hashing.words(data, offsets)
    for size in (7, 64, 1000):
        monkeypatch.setattr(hashing, "CHUNK", size)
        cut = hashing.words(data, offsets)
        assert all(np.array_equal(getattr(whole, n), getattr(cut, n)) for n in ("start", "end", "first", "hash"))
