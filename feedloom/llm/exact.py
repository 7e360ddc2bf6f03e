"""Exact deduplication of texts with counting quotient filters.

A 48-bit fingerprint of the normalised text is split into a quotient (high bits) and a remainder. Every partition of the
fingerprint table builds its own filter: one row per quotient with the sorted remainders of its run and their counts. Runs
of one quotient merge without loss, because quotient and remainder give the fingerprint back. The number of quotients
follows the number of rows, so a run has about ``RUN`` entries at any size, and a fingerprint however frequent is one entry
per partition. Fingerprints counted more than once go to verification, where texts are grouped by their bytes; two texts
that share a fingerprint by chance part there.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bloom import maybe_in, might_be
from feedloom.llm.common import fresh, picked, pieces, store, text_buffer

FINGERPRINT_BITS, RUN = 48, 1 << 14
_FILTER = "quotient long, remainders binary, counts binary"


def _normalised(column: pa.Array) -> Iterator[bytes]:
    """Each text in UTF-8 with A-Z in lower case; a null text is empty."""
    data, offsets = text_buffer(column)
    raw = data.tobytes().lower()
    return (raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()))


def _fingerprint(sha: bytes) -> int:
    return int.from_bytes(sha[: FINGERPRINT_BITS // 8], "big")


def _digests(column: pa.Array) -> list[pa.Array]:
    """Fingerprints and SHA-256 of the normalised texts."""
    shas = [hashlib.sha256(t).digest() for t in _normalised(column)]
    return [pa.array(map(_fingerprint, shas), pa.int64()), pa.array(shas, pa.binary())]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_digests(part.column("text"))], ["doc_id", "fingerprint", "sha"])


def merge_runs(remainders: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run with added counts from several runs of a quotient."""
    order = np.argsort(remainders, kind="stable")
    remainders, counts = remainders[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], remainders[1:] != remainders[:-1]])) if len(remainders) else np.zeros(0, np.int64)
    return remainders[first], np.add.reduceat(counts, first) if len(first) else counts


def _partition_filter(quotient_bits: int):
    shift = FINGERPRINT_BITS - quotient_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return merge_runs(np.concatenate([prints, *waiting]), np.concatenate([counts, np.ones(size, np.int64)]))

        for batch in batches:
            waiting.append(np.asarray(batch.column("fingerprint")))
            size += batch.num_rows
            if size > len(prints) + 10_000:  # as much again as is sorted already
                prints, counts = merged()
                waiting, size = [], 0
        prints, counts = merged()
        quotients, remainders = prints >> shift, prints & ((1 << shift) - 1)
        starts = np.flatnonzero(np.concatenate([[True], quotients[1:] != quotients[:-1]])) if len(quotients) else []
        runs = list(zip(starts, [*starts[1:], len(quotients)]))
        for at in range(0, len(runs), 10_000):
            part = runs[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(quotients[a]) for a, _ in part], pa.int64()),
                    pa.array([remainders[a:b].tobytes() for a, b in part], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in part], pa.binary()),
                ],
                ["quotient", "remainders", "counts"],
            )

    return run


def _merge(shift: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        values = np.frombuffer(b"".join(group["remainders"]), np.int64)
        remainders, counts = merge_runs(values, np.frombuffer(b"".join(group["counts"]), np.int64))
        return pd.DataFrame({"fingerprint": (np.int64(group["quotient"].iloc[0]) << np.int64(shift)) | remainders, "copies": counts})

    return run


def counting_filter(fingerprints: DataFrame, rows: int) -> DataFrame:
    """The merged filter of a table of fingerprints as (fingerprint, copies)."""
    bits = min(FINGERPRINT_BITS - 1, max(1, math.ceil(math.log2(max(rows, 1) / RUN + 1))))
    filters = fingerprints.select("fingerprint").mapInArrow(_partition_filter(bits), _FILTER)
    return filters.groupBy("quotient").applyInPandas(_merge(FINGERPRINT_BITS - bits), "fingerprint long, copies long")


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies that lie in one batch become one row, so that a hot text is shuffled once per batch."""
    for batch in batches:
        seen: dict[bytes, list] = {}
        for part in pieces(batch):
            for text, doc_id in zip(_normalised(part.column("text")), part.column("doc_id").to_pylist()):
                row = seen.get(text)
                if row is None:
                    sha = hashlib.sha256(text).digest()
                    row = seen[text] = [_fingerprint(sha), sha, None, 0]
                row[2] = doc_id if row[2] is None or (doc_id is not None and doc_id > row[2]) else row[2]
                row[3] += 1
        columns = list(zip(*seen.values())) or [[]] * 4
        kinds = pa.int64(), pa.binary(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["text", "fingerprint", "sha", "keep_id", "copies"]
        )


def _digested(text: pa.Array) -> pa.Array:
    """Struct (fingerprint, sha) of each text."""
    batch = pa.RecordBatch.from_arrays([text.cast(pa.large_string())], ["text"])
    made = [pa.StructArray.from_arrays(_digests(part.column("text")), ["fingerprint", "sha"]) for part in pieces(batch)]
    return pa.concat_arrays(made) if made else pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], ["fingerprint", "sha"])


def _groups(docs: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated fingerprints, and groups of equal texts (fingerprint, sha, keep_id, copies) that their bytes confirm."""
    repeated = store(counting_filter(prints, prints.count()).where("copies > 1").select("fingerprint"), "repeated")
    collapsed = docs.mapInArrow(_collapsed, "text binary, fingerprint long, sha binary, keep_id long, copies long")
    routed = maybe_in(collapsed, "fingerprint", repeated).join(repeated, "fingerprint", "left_semi")
    # Only the bytes decide here; the digest goes along as the name of the verified group.
    verified = routed.groupBy("fingerprint", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("copies").alias("copies"), F.min("sha").alias("sha")).drop("text")
    return repeated, store(verified, "verified")


def exact_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest doc_id stays; a null id is smaller than any other. Rows that repeat id and text are one document: all of them
    are marked as kept, and each counts in group_size. Other columns are not looked at. An empty table gives no rows.
    """
    docs = picked(documents, doc_id=id_column, text=text_column)
    prints = store(docs.mapInArrow(_fingerprints, "doc_id long, fingerprint long, sha binary"), "fingerprints")
    _, verified = _groups(docs, prints)
    return prints.join(verified, ["fingerprint", "sha"], "left").select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("copies").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of equal texts, with its columns: the one with the largest id, one of them if several have it.

    Texts that are not repeated, and null ids without an equal text, are passed on without a shuffle. An empty table gives
    no rows.
    """
    docs = picked(documents, doc_id=id_column, text=text_column)
    prints = store(docs.mapInArrow(_fingerprints, "doc_id long, fingerprint long, sha binary"), "fingerprints")
    repeated, verified = _groups(docs, prints)
    own = {n: fresh(documents.columns, n) for n in ("digest", "fingerprint", "sha", "keep_id")}
    kind = "struct<fingerprint: long, sha: binary>"
    digest = F.arrow_udf(_digested, kind).asNondeterministic()(F.col(f"`{text_column}`").cast("string"))
    marked = documents.withColumn(own["digest"], digest).withColumns({own[n]: F.col(f"{own['digest']}.{n}") for n in ("fingerprint", "sha")}).drop(own["digest"])
    suspect = might_be(own["fingerprint"], repeated)
    groups = verified.select(*[F.col(n).alias(f"g_{n}") for n in ("fingerprint", "sha", "keep_id")], F.lit(True).alias("g_found"))
    joined = marked.where(suspect).join(groups, (F.col(own["fingerprint"]) == F.col("g_fingerprint")) & (F.col(own["sha"]) == F.col("g_sha")), "left")
    stays = F.col("g_found").isNull() | F.col(f"`{id_column}`").eqNullSafe(F.col("g_keep_id"))
    checked = joined.where(stays).drop(*groups.columns).dropDuplicates([own["sha"]])
    return marked.where(~suspect).unionByName(checked).select(*[F.col(f"`{c}`") for c in documents.columns])
