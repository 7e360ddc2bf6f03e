"""Schema mapping: arbitrary source headers to the canonical feedback columns, and row numbering."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import blank_to_null, nonblank
from feedloom.session import materialize
from feedloom.vocab.columns import ALIASES, CATEGORICAL


def normalize_column_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def suggest_mapping(columns: Sequence[str]) -> dict[str, str | None]:
    """For each canonical field the first alias with a source column nobody took yet."""
    free = list(columns)
    mapping: dict[str, str | None] = {}
    for field, aliases in ALIASES.items():
        ranked = [c for alias in aliases for c in free if normalize_column_name(c) == alias]
        mapping[field] = ranked[0] if ranked else None
        if ranked:
            free.remove(ranked[0])
    return mapping


def check_mapping(columns: Sequence[str], mapping: Mapping[str, str | None]) -> None:
    sources = [s for s in mapping.values() if s]
    if len(sources) != len(set(sources)):
        raise ValueError("One source column is used for several fields.")
    if mapping.get("review_text") not in columns:
        raise ValueError("review_text needs a column of the table.")


def conform(df: DataFrame, mapping: Mapping[str, str | None] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Project to the canonical fields in fixed order; unmapped fields are null strings."""
    mapping = dict(mapping or suggest_mapping(df.columns))
    check_mapping(df.columns, mapping)
    fields = [
        (F.col(f"`{mapping[f]}`") if mapping.get(f) in df.columns else F.lit(None).cast("string")).alias(f)
        for f in ALIASES
    ]
    return df.select(*fields, *keep)


def generated_id(review_id: Column, row_number: Column) -> Column:
    """Keep a non-blank id as it is, else derive one from the source row number."""
    text = review_id.cast("string")
    return F.when(nonblank(text), text).otherwise(F.format_string("IF-%07d", row_number))


def tidy_categories(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    return df.withColumns({c: blank_to_null(F.col(c)) for c in columns if c in df.columns})


def number_rows(df: DataFrame, order_by: str, *, name: str = "source_row_number", start: int = 2) -> DataFrame:
    """Dense row numbers in the order of a key of any sortable type, without sorting the table in one task.

    Spark deals the rows into ranges of the key, whose number follows the shuffle settings and the measured size, and sorts
    each. The dealt rows are stored, because the numbers are only right if counts and rows come from the same deal. A range
    starts after the rows of the ranges before it.
    """
    position = F.monotonically_increasing_id()  # task number in the high bits, row in the task in the low 33
    dealt = df.repartitionByRange(order_by).sortWithinPartitions(order_by).withColumns({
        "_range": F.shiftright(position, 33), "_inside": position.bitwiseAND(F.lit((1 << 33) - 1)),
    })
    dealt = materialize(dealt)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = sizes.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    return (
        dealt.join(before, "_range")
        .withColumn(name, (F.col("_before") + F.col("_inside") + F.lit(start)).cast("long"))
        .drop("_range", "_before", "_inside")
    )


def number_file_rows(df: DataFrame, *, name: str = "source_row_number", start: int = 2) -> DataFrame:
    """Dense row numbers in file order for a frame read straight from files.

    Rows are ordered by file, then by split, then by position in the split. The offset table has one row per input
    split; Spark decides from its measured size whether to broadcast it.
    """
    local = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_position"),
    )
    splits = local.groupBy("_file", "_block").agg(F.count("*").alias("_rows"), F.min("_position").alias("_first"))
    offsets = splits.select(
        "_file", "_block", "_first",
        (F.sum("_rows").over(Window.orderBy("_file", "_block")) - F.col("_rows")).alias("_before"),
    )
    number = F.col("_before") + F.col("_position") - F.col("_first") + F.lit(start)
    return (
        local.join(offsets, ["_file", "_block"]).withColumn(name, number.cast("long"))
        .drop("_file", "_block", "_position", "_first", "_before")
    )
