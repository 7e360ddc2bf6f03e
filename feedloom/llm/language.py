"""Language identification by rank-order profiles.

A profile is the ranked list of a language's most frequent letter n-grams (one to three letters, words padded by a blank),
learned from all texts of that language. A document's own ranked list is compared with each profile by out-of-place distance:
the sum over its n-grams of how far the ranks lie apart, with the profile length for n-grams the profile does not have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import in_share, pieces
from feedloom.llm.exact import merge_runs

#: N-grams of a language profile, and of a document's list.
PROFILE, LISTED = 400, 300
_BITS = np.int64(21)  # of a code point; three fit into a long


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of all texts, and for each text and n-gram (index into them) one entry per occurrence."""
    lowered = [t.lower() for t in texts]
    joined = f" {' \n '.join(lowered)} "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.flatnonzero(np.bincount(points, minlength=1))
    letter = np.array([chr(c).isalpha() for c in symbols])
    symbols = np.concatenate([[32, 10], symbols[letter]])
    place = np.zeros(int(points.max(initial=32)) + 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    line = points == 10
    own = place[points]  # anything but a letter is a blank
    own[line] = 0
    # A line break inside a text is a blank; the ones put between texts are told by their position.
    edges = np.cumsum([len(t) + 3 for t in lowered])[:-1] - 1
    text_of = np.zeros(len(points), np.int64)
    text_of[edges] = 1
    text_of = np.cumsum(text_of)
    keep = np.ones(len(own), dtype=bool)
    keep[1:] = (own[1:] > 0) | (own[:-1] > 0)  # one blank between words, one before each text
    keep[edges] = True
    own, text_of, size = own[keep], text_of[keep], len(symbols)
    codes, owners = [], []
    for width in (1, 2, 3):
        n = len(own) - width + 1
        if n <= 0:
            continue
        code = np.zeros(n, np.int64)
        for at in range(width):
            code = code * size + own[at : at + n]
        valid = (text_of[:n] == text_of[width - 1 :]) & (code > 0)
        if width == 3:
            valid &= own[1 : n + 1] > 0  # no blank in the middle
        codes.append(code[valid] + (width - 1) * size**3)
        owners.append(text_of[:n][valid])
    codes, owners = np.concatenate(codes or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    if size**3 * 3 <= 1 << 23:
        present = np.flatnonzero(np.bincount(codes, minlength=1))
        index = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
        index[present] = np.arange(len(present))
        which = index[codes]
    else:
        present, which = np.unique(codes, return_inverse=True)
    width, rest = present // size**3, present % size**3
    points_of = symbols.astype(np.int64)
    portable = points_of[rest % size]
    portable = np.where(width >= 1, portable | points_of[rest // size % size] << _BITS, portable)
    portable = np.where(width >= 2, portable | points_of[rest // size**2] << 2 * _BITS, portable)
    return portable, which, owners


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of each language in this partition."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part in pieces(batch):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in set(langs):
                grams, which, _ = _grams([t or "" for t, own in zip(texts, langs) if own == lang])
                known = totals.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                totals[lang] = merge_runs(np.concatenate([known[0], grams]), np.concatenate([known[1], np.bincount(which, minlength=len(grams))]))
    for lang, (grams, counts) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])


def learn_profiles(examples: DataFrame, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """Profiles of all languages in (text, lang); rows without a language teach nothing.

    Counts cover every example; only the first ``PROFILE`` n-grams of each language reach the driver. More than
    ``max_languages`` languages are refused, which bounds what tasks receive.
    """
    counts = examples.where("lang IS NOT NULL").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    rows = ranked.limit(max_languages * PROFILE + 1).collect()
    if len(rows) > max_languages * PROFILE:
        raise ValueError(f"More than {max_languages} languages; raise max_languages if they fit into memory.")
    profiles: dict[str, np.ndarray] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        profiles.setdefault(row.lang, []).append(row.gram)
    return {lang: np.array(grams, np.int64) for lang, grams in profiles.items()}


def _judge(texts: list[str], profiles: list[np.ndarray]) -> list[tuple[int, float]]:
    """Index of the nearest profile (-1: no letter) and a score for each text."""
    grams, which, owners = _grams(texts)
    if not len(grams):
        return [(-1, 0.0)] * len(texts)
    ranks = np.full((len(profiles), len(grams)), PROFILE, np.int64)
    order = np.argsort(grams)
    for own, profile in zip(ranks, profiles):
        at = np.searchsorted(grams, profile, sorter=order)
        at[at == len(grams)] = 0
        found = grams[order[at]] == profile
        own[order[at[found]]] = np.flatnonzero(found)
    # Equal counts are ordered by the n-gram, so that a list does not depend on the other texts of the batch.
    tie = np.empty(len(grams), np.int64)
    tie[order] = len(grams) - np.arange(len(grams))
    starts = np.searchsorted(owners_sorted := np.sort(owners, kind="stable"), np.arange(len(texts) + 1))
    by_text = which[np.argsort(owners, kind="stable")] if len(owners_sorted) else which
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if a == b:
            out.append((-1, 0.0))
            continue
        counts = np.bincount(by_text[a:b], minlength=len(grams))
        key = counts * (len(grams) + 1) + tie
        key[counts == 0] = 0
        top = np.argpartition(key, -LISTED)[-LISTED:] if len(key) > LISTED else np.arange(len(key))
        top = top[np.argsort(-key[top])]
        top = top[counts[top] > 0]
        of = ranks[:, top]
        distance = np.where(of == PROFILE, PROFILE, np.abs(of - np.arange(len(top)))).sum(axis=1) / (PROFILE * len(top))
        best = int(np.argmin(distance))
        others = np.delete(distance, best)
        # How much nearer the best profile is than the next one; with a single profile, how near it is.
        score = float((others.min() - distance[best]) / max(others.min(), 1e-12)) if len(others) else float(1 - distance[best])
        out.append((best, min(1.0, max(0.0, score))))
    return out


def language_of(text: Column, profiles: dict[str, np.ndarray]) -> Column:
    """Struct (lang, score) of a text; lang is ``und`` and score 0 if it is null, has no letter or nothing was learned."""
    names = sorted(profiles)
    lists = [profiles[n] for n in names]

    def judge(column: pa.Array) -> pa.Array:
        found: list[tuple[int, float]] = []
        batch = pa.RecordBatch.from_arrays([column.cast(pa.large_string())], ["text"])
        for part in pieces(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            found += _judge(texts, lists) if lists else [(-1, 0.0)] * len(texts)
        return pa.StructArray.from_arrays(
            [pa.array([names[i] if i >= 0 else "und" for i, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang", "score"]
        )

    return F.arrow_udf(judge, "struct<lang: string, score: double>").asNondeterministic()(text.cast("string"))


def identify_languages(
    documents: DataFrame, held_out: tuple[int, int] = (4, 2), id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (0 to 1).

    Rows whose crc32(id) modulo the first number of ``held_out`` is the second teach nothing. Null and letterless texts are
    ``und``; ties between languages go to the first by name. Null ids are never held out; repeated rows are judged alike;
    other columns are not looked at. An empty table gives no rows.
    """
    rows = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"), F.col(f"`{lang_column}`").alias("lang"))
    out = in_share(F.col("doc_id"), *held_out)
    profiles = learn_profiles(rows.where(~out).select("text", "lang"))
    return rows.select("doc_id", out.alias("held_out"), language_of(F.col("text"), profiles).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
