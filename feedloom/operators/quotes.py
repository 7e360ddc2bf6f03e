"""Grounded quotes and representative review ids, chosen by fixed rankings from exact source rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import iso_date
from feedloom.functions.numbers import safe_float
from feedloom.functions.text import nonblank, trim_ws
from feedloom.operators.grouping import ids_in_rank_order, null_safe, optional, top_per_group, window, with_keys, without_keys
from feedloom.session import materialize
from feedloom.vocab.themes import POSITIVE_FEEDBACK

QUOTE_FIELDS = ("review_id", "original_text", "date", "rating", "platform", "primary_theme")
MAX_QUOTES = 5


def representative_quotes(df: DataFrame, by: Sequence[str] = (), *, limit: int = MAX_QUOTES,
                          order_by: str = "source_row_number") -> DataFrame:
    """Up to five distinct texts per theme, best first.

    Equal texts collapse to their first source row before anything is ranked; the ranking then keeps ``limit`` rows
    per theme in every partition ahead of its shuffle.
    """
    keys = [*by, "primary_theme", "_text"]
    fields = [F.col(c) for c in QUOTE_FIELDS if c not in ("primary_theme", *by) and c in df.columns]
    record = F.struct(*fields, "sentiment", "classification_confidence")
    texts = (
        df.filter(F.col("primary_theme").isNotNull() & nonblank(F.col("original_text")))
        .withColumn("_text", trim_ws(F.col("original_text")))
        .groupBy(*keys).agg(F.min_by(record, order_by).alias("_first"))
        .select(*by, "primary_theme", "_text", "_first.*")
    )
    wanted = F.when(F.col("primary_theme") == POSITIVE_FEEDBACK, "Positive").otherwise("Negative")
    order = [
        F.desc(F.coalesce(F.col("sentiment") == wanted, F.lit(False)).cast("int")),
        F.desc("classification_confidence"),
        F.desc(F.length("_text").between(20, 400).cast("int")),
        F.asc("review_id"),
    ]
    best = top_per_group(texts, [*by, "primary_theme"], order, min(limit, MAX_QUOTES), "rank")
    return best.select(*by, *[c for c in QUOTE_FIELDS if c in best.columns and c not in by], "rank")


def quotes_by_theme(quotes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per theme with its quotes as an ordered array."""
    fields = [c for c in quotes.columns if c not in by]
    return quotes.groupBy(*by, "primary_theme").agg(
        F.array_sort(F.collect_list(F.struct("rank", *[c for c in fields if c not in ("rank", "primary_theme")]))).alias("quotes")
    )


def ungrounded_quotes(quotes: DataFrame, source: DataFrame) -> DataFrame:
    """Quotes whose id, text and theme do not occur together in the source; empty means all are grounded."""
    keys = ["review_id", "original_text", "primary_theme"]
    return quotes.join(source.select(*keys), keys, "left_anti")


def representative_ids(df: DataFrame, by: Sequence[str] = (), *, limit: int = 3) -> DataFrame:
    """Per theme the first distinct review ids: negative first, then by confidence, then by id."""
    confidence = F.coalesce(optional(df, "classification_confidence", 0.0, "double"), F.lit(float("-inf")))
    negative = F.col("sentiment") == "Negative"
    per_id = df.filter(F.col("primary_theme").isNotNull()).groupBy(*by, "primary_theme", "review_id").agg(
        F.max(F.when(negative, confidence)).alias("_negative"), F.max(confidence).alias("_any")
    )
    order = [
        F.desc(F.col("_negative").isNotNull().cast("int")), F.desc(F.coalesce("_negative", "_any")), F.asc("review_id"),
    ]
    best = top_per_group(per_id, [*by, "primary_theme"], order, limit, "rank")
    return best.select(*by, F.col("primary_theme").alias("theme"), "review_id", "rank")


def request_ids(df: DataFrame, by: Sequence[str] = (), *, limit: int = 3) -> DataFrame:
    """Per request group the first rows by confidence, then id; ids may repeat."""
    confidence = F.coalesce(optional(df, "feature_request_confidence", 0.0, "double"), F.lit(0.0))
    requests = df.filter(F.col("is_feature_request") & F.col("feature_request_group").isNotNull()).select(
        *by, "feature_request_group", "review_id", confidence.alias("_confidence")
    )
    order = [F.desc("_confidence"), F.asc("review_id")]
    return top_per_group(requests, [*by, "feature_request_group"], order, limit, "rank").drop("_confidence")


def request_quotes(df: DataFrame, *, limit: int = 5, order_by: str = "source_row_number") -> DataFrame:
    """Per request group the first distinct texts by confidence, then id."""
    requests = df.filter(F.col("is_feature_request") & F.col("feature_request_group").isNotNull())
    keys = ["feature_request_group", "original_text"]
    best = F.struct(
        (-F.coalesce("feature_request_confidence", F.lit(float("-inf")))).alias("order"), "review_id",
        F.col(order_by).alias("row"), optional(df, "platform").alias("platform"),
        F.col("feature_request_confidence").alias("confidence"),
    )
    texts = requests.groupBy(*keys).agg(F.min(best).alias("_best")).select(
        *keys, "_best.review_id", "_best.platform", F.col("_best.confidence").alias("feature_request_confidence")
    )
    order = [F.desc("feature_request_confidence"), F.asc("review_id")]
    return top_per_group(texts, ["feature_request_group"], order, limit, "rank")


def id_lists(ranked: DataFrame, keys: Sequence[str], name: str = "representative_review_ids") -> DataFrame:
    return ranked.groupBy(*keys).agg(ids_in_rank_order("rank", "review_id").alias(name))


def quote_record(df: DataFrame, evidence_type: Column) -> Column:
    """The eleven-field evidence record of a row; absent columns are null."""
    def text(name: str) -> Column:
        return optional(df, name).cast("string")

    return F.struct(
        F.col("review_id").cast("string").alias("review_id"),
        F.col("original_text").cast("string").alias("review_text"),
        safe_float(optional(df, "rating", data_type="double")).alias("rating"),
        iso_date(optional(df, "date", data_type="timestamp_ntz")).alias("date"),
        text("platform").alias("platform"),
        text("app_version").alias("app_version"),
        text("sentiment").alias("sentiment_label"),
        text("primary_theme").alias("pain_point_theme"),
        text("feature_request_group").alias("feature_request_group"),
        evidence_type.alias("evidence_type"),
        optional(df, "source_row_number", data_type="long").cast("long").alias("source_row_index"),
    )


def unique_quote_evidence(df: DataFrame, groups: DataFrame, by: Sequence[str] = (), *, limit: int = 16,
                          depth: int = 50) -> DataFrame:
    """One quote per evidence group, taken in group order, never reusing an id or a text.

    ``groups`` has columns kind ('pain_point' or 'feature_request'), key and position (plus ``by``). The choice is
    greedy, so every group's best ``depth`` rows are folded in order. A group whose rows were all taken, but that
    has more than ``depth`` rows, is resolved afterwards in full by ``_fill_rounds``; results never depend on depth.
    """
    candidates = _ranked_candidates(df, groups, by)
    group_keys = [*by, "position"]
    top = top_per_group(candidates, group_keys, _candidate_order(), depth, "_rank")
    folded = top.groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct("position", "_rank", "_id", "_text", "quote")
    )).alias("_rows"), _full_groups(depth).alias("_full"))
    clash = lambda done, c: F.exists(
        done, lambda d: (d["position"] == c["position"]) | (d["_id"] == c["_id"]) | (d["_text"] == c["_text"])
    )
    picks = F.aggregate(
        "_rows", F.filter("_rows", lambda r: F.lit(False)),
        lambda done, c: F.when(clash(done, c), done).otherwise(F.concat(done, F.array(c))),
    )
    picked = materialize(folded.select(*by, picks.alias("_picks"), "_full").withColumn(
        "_open", F.size(F.array_except("_full", F.transform("_picks", lambda p: p["position"]))) > 0
    ))
    rows = picked.filter("NOT _open").select(*by, F.explode("_picks").alias("p")).select(*by, "p.position", "p.quote")
    done, unresolved = _first_quotes(rows, by, limit), picked.filter("_open").select(*by)
    if picked.filter("_open").isEmpty():
        return done
    # Only the segments that are still open are gone through in full.
    return done.unionByName(_fill_rounds(with_keys(candidates, unresolved, by), groups, by, limit))


def _candidate_order() -> list[Column]:
    return [F.desc("_first"), F.desc("_confidence"), F.asc("_id"), F.asc("_row"), F.asc("_text")]


def _full_groups(depth: int) -> Column:
    """Positions whose candidate list was cut at ``depth``."""
    return F.collect_set(F.when(F.col("_rank") >= depth, F.col("position")))


def _ranked_candidates(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of each evidence group with their ranking keys; blank texts are out."""
    def rows(kind: str, column: str, first: Column, confidence: Column) -> DataFrame:
        keys = groups.filter((F.col("kind") == kind) & F.col("key").isNotNull()).select(*by, F.col("key").alias(column), "position")
        return null_safe(df.filter(nonblank(F.col("original_text"))), keys, [*by, column], "inner").select(
            *by, "position", first.alias("_first"), F.coalesce(confidence, F.lit(float("-inf"))).alias("_confidence"),
            F.col("review_id").cast("string").alias("_id"), F.col("original_text").alias("_text"),
            optional(df, "source_row_number", 0, "long").alias("_row"),
            quote_record(df, F.lit(kind)).alias("quote"),
        )

    pain = rows(
        "pain_point", "primary_theme", F.coalesce(F.col("sentiment") == "Negative", F.lit(False)).cast("int"),
        optional(df, "classification_confidence", 0.0, "double"),
    )
    if "feature_request_group" not in df.columns:
        return pain
    requests = rows(
        "feature_request", "feature_request_group", F.lit(0), optional(df, "feature_request_confidence", data_type="double")
    )
    return pain.unionByName(requests)


def _first_quotes(rows: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    rank = F.row_number().over(window(by, F.col("position")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select(*by, "rank", "quote")


def _fill_rounds(candidates: DataFrame, groups: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """The same greedy choice, one group position per round, with all taken ids and texts excluded by anti-joins."""
    positions = [r[0] for r in groups.select("position").distinct().orderBy("position").collect()]
    taken = None
    for position in positions:
        rows = candidates.filter(F.col("position") == position)
        if taken is not None:
            for column in ("_id", "_text"):
                rows = without_keys(rows, taken, [*by, column])
        best = top_per_group(rows, [*by, "position"], _candidate_order(), 1, "_rank").drop("_rank")
        taken = best if taken is None else taken.unionByName(best)
    return _first_quotes(taken.select(*by, "position", "quote"), by, limit)
