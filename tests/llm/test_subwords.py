"""Subword classifier: its features against plain Python, planted and held-out accuracy, edge cases."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from feedloom.llm import subwords
from feedloom.llm.common import in_share
from feedloom.llm.hashing import words
from feedloom.llm.subwords import Model, classify_quality, features, learn, log_odds, train

KIND = "doc_id long, text string"
LABELS = "doc_id long, quality int"


def plain_features(text):
    """Buckets of a text, one by one."""
    raw = (text or "").encode()
    parts = [p for p in raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\v", b" ").replace(b"\f", b" ").replace(b"\r", b" ").split(b" ") if p]
    hashes = [words(np.frombuffer(p, np.uint8), np.array([0, len(p)])).hash for p in parts]
    out = Counter({subwords._LINE: raw.count(b"\n") + 1})
    for p, h in zip(parts, hashes):
        out[int(subwords._bucket(h, 0)[0])] += 1
        spelled = bytes([2]) + p + bytes([3])
        for width in subwords.GRAMS:
            for at in range(len(spelled) - width + 1):
                value = sum((spelled[at + i] + 1) * int(subwords._PLACE[i]) for i in range(width)) % (1 << 64)
                out[int(subwords._bucket(np.array([value], np.uint64), width)[0])] += 1
    for a, b in zip(hashes, hashes[1:]):
        out[int(subwords._bucket(a ^ b, 1)[0])] += 1
    return out


TEXTS = [None, "", " \n\t", "one", "a a a", "été ñandú 日本 x", "two words\nnext line", "b" * 500 + " c", "x\ny\nz", "".join(f"w{i} " for i in range(300))]


def test_features_and_odds_equal_plain_python():
    column = pa.array(TEXTS, pa.large_string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array([1] * len(TEXTS)), column], ["doc_id", "label", "text"])
    counted = [r for b in subwords._counted(iter([batch])) for r in b.to_pylist()]
    model = Model(np.random.default_rng(1).normal(size=1 << subwords.BITS), 0.25)
    odds = log_odds(column, model)
    for text, row, found in zip(TEXTS, counted, odds):
        want = plain_features(text)
        assert dict(zip(row["buckets"], row["counts"])) == dict(want), text
        assert found == pytest.approx(sum(n * model.weight[b] for b, n in want.items()) / sum(want.values()) + 0.25)
    assert len(features(pa.array([], pa.large_string())).first) == 1


def test_gradient_is_that_of_the_loss():
    """One step of training moves the parameters against the numerical gradient of the cross entropy."""
    examples, labels = [(np.array([1, 5]), np.array([1.0, 3.0])), (np.array([5, 9]), np.array([2.0, 2.0]))], np.array([0, 1])
    before = train(examples, labels, steps=0)
    assert np.allclose(before, 0)
    weight = train(examples, labels, steps=400, rate=0.5)
    scores = [(c / c.sum()) @ weight[b] for b, c in examples]
    assert scores[0] < -2 < 2 < scores[1]


def planted(n, seed):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abdeilmnorstu") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [draw.choice(stems) for _ in range(draw.randint(30, 120))]
        bad = i % 4 == 0
        if bad and i % 8 == 0:
            text = [w + draw.choice(["$$$", "%%", "&&"]) for w in text]
        elif bad:
            text = [text[0]] * len(text)
        rows.append((i, " ".join(text), int(not bad)))
    return rows


def test_planted_and_only_from_rows_that_teach(spark):
    rows = planted(400, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], KIND).selectExpr("*", "'x' AS label", "1 AS score", "2 AS quality")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], LABELS)
    got = {r.doc_id: r for r in classify_quality(docs, labels, steps=8000).collect()}
    held = [(i, q) for i, _, q in rows if got[i].held_out]
    assert len(held) > 40 and {i for i, _ in held} == {r.doc_id for r in docs.where(in_share(F.col("doc_id"), 5, 0)).collect()}
    assert all(got[i].predicted == q for i, q in held if i % 8 != 4)
    # A text of one word over and over is told by its pairs alone, against everything the word itself says.
    same = [got[i].predicted for i, _ in held if i % 8 == 4]
    assert len(same) >= 8 and sum(same) <= len(same) // 8
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("quality", F.when(in_share(F.col("doc_id"), 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in classify_quality(docs, turned, steps=8000).collect()} == {i: r.score for i, r in got.items()}


def test_held_out_accuracy(spark):
    """The registered query over a whole table: documents that teach nothing are told apart."""
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op12_quality_classifier"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    judged = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r for r in judged if r.quality], [r for r in judged if not r.quality]
    assert len(good) > 40 and sum(r.predicted for r in good) >= 0.98 * len(good)
    assert sum(not r.predicted for r in bad) >= 0.7 * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in judged)


def test_edge_cases(spark):
    rows = planted(80, 3)
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (None, "text"), (900, ""), (901, long), (1, "again another text"), (902, "same"), (902, "same")], KIND)
    odd = [(None, 1), (2, None), (3, 7), (5, 0), (5, 1), (901, 1), (7777, 0)]
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + odd, LABELS)
    got = classify_quality(docs, labels, steps=500).collect()
    assert len(got) == 87 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    same = [r for r in got if r.doc_id == 902]
    assert len(same) == 2 and same[0] == same[1] and not any(r.held_out for r in got if r.doc_id is None)
    for text, known in ((docs, spark.createDataFrame([], LABELS)), (docs, labels.where("quality = 1")), (spark.createDataFrame([], KIND), labels)):
        assert learn(text, known.withColumnRenamed("quality", "label")) is None
        assert {r.score for r in classify_quality(text, known).collect()} <= {0.5}


def test_sample_is_bounded_and_shares_come_back(spark):
    rows = planted(400, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], KIND)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, label int")
    teach = [q for i, _, q in rows if i in {r.doc_id for r in docs.where(~in_share(F.col("doc_id"), 5, 0)).collect()}]
    model = learn(docs, labels, max_examples=20, steps=100)
    assert model.offset == pytest.approx(np.log(sum(teach) / (len(teach) - sum(teach))))
