"""Helpers of the operators: stored intermediates, safe column names, Arrow text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.session import shared_folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder (``spark.checkpoint.dir``) and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like ``store``, bucketed by a column, so that a join on it reads the files in place instead of shuffling them again.

    Bucketing needs a table; it has a name of its own and its files lie in the shared folder.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark).rstrip('/')}/{table}"
    df.write.format("parquet").options(compression="zstd", path=path).bucketBy(buckets, column).saveAsTable(table)
    return spark.table(table)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator works on, under its own names and types, so that other columns never clash."""
    kinds = {"doc_id": "long", "text": "string"}
    found = {own: F.col(f"`{source}`") for own, source in columns.items()}
    return df.select(*[(c.cast(kinds[own]) if own in kinds else c).alias(own) for own, c in found.items()])


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that is not taken, compared as Spark does, without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_share(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; an id that is null belongs to no share."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; a null text is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row runs of about ``size`` bytes of text; a longer text is a run of its own, whole."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    ends = np.cumsum(lengths)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
