"""From raw documents to tokens: quality rules, exact and near deduplication, mixing of sources, byte-level BPE.

Every stage works on all rows that its predecessor kept and returns the columns of documents; the last returns tokens.
Null and empty texts fail the quality rules, so later stages meet none. A document that the mix repeats is encoded as often.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.registry import prepare
from feedloom.llm import exact, minhash
from feedloom.llm.bpe import round_trip
from feedloom.llm.common import store
from feedloom.llm.mixing import mix_rows
from feedloom.llm.quality import keep_good
from feedloom.llm.queries import table, vocabulary

#: Flatness that the mix aims at, as a share of the largest entropy, and how often a rare source may repeat.
ENTROPY, REPETITIONS = 0.9, 2.0

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules do not reject."""
    prepare(spark)
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest id."""
    prepare(spark)
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, the one with the smallest id."""
    prepare(spark)
    return minhash.keep_one(docs, width=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of rare sources again until the sources have their target weights."""
    prepare(spark)
    return mix_rows(docs, entropy=ENTROPY, repetitions=REPETITIONS).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens, and the digests of ids and of the decoded bytes."""
    prepare(spark)
    return round_trip(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Vote models, near duplicates and byte pairs are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stage's rows stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
