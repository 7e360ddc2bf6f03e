"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from feedloom.llm.bpe import decoded, encode, merge, round_trip
from feedloom.llm.queries import vocabulary


@pytest.fixture(scope="module")
def words():
    return vocabulary()


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


TEXTS = [
    "", None, "Hello world", "it's   the\n\n end \t ", "<|endoftext|> <s>", "naïve café — Straße", "日本語 テキスト 12345", "🙂🙃" * 5, "a" * 5000, "ab" * 3000, " " * 1000,
    "\x00\x01​", "ñ́", "don't 'll", "\r\n\r\nx",
]


def test_equals_the_library(spark, words, library):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, "again", "x", 1)], "doc_id long, text string, tokens string, block long").repartition(3)
    got = encode(frame, words).collect()
    want = [(i, library.encode_ordinary(t or "")) for i, t in [*enumerate(TEXTS), (None, "no id"), (3, "again")]]
    assert sorted(((r.doc_id, list(r.tokens)) for r in got), key=str) == sorted(want, key=str)


def test_blocks_may_be_small(spark, words, library, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdefé ñ.,\n") for _ in range(rng.randrange(12))) for _ in range(40))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    got = {r.doc_id: r for r in round_trip(frame, words).collect()}
    for i, text in rows:
        ids = library.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_and_short_merges_agree(words, library):
    rng = random.Random(4)
    for length in (1, 2, 63, 64, 65, 66, 200, 999):
        text = "".join(rng.choice("etaoinshrdlu") for _ in range(length))
        assert merge(text.encode(), words.ranks) == library.encode_ordinary(text)


def test_decoding_and_empty_tables(spark, words):
    frame = spark.createDataFrame([(1, [72, 5]), (2, []), (3, None)], "doc_id long, tokens array<int>")
    table = {rank: token for token, rank in words.ranks.items()}
    got = {r.doc_id: bytes(r.text) for r in frame.select("doc_id", decoded(F.col("tokens"), words).alias("text")).collect()}
    assert got == {1: table[72] + table[5], 2: b"", 3: b""}
    assert round_trip(spark.createDataFrame([], "doc_id long, text string"), words).collect() == []
