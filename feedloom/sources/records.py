"""Records of CSV files whose quoted values hold line breaks, read in as many tasks as the files have splits.

A line goes on a record if an odd number of quotes stands before it in its file. Quotes are counted per split, a running total
over the splits of a file (a small table) tells how each split begins, and a window inside a split does the rest. Lines that
are records by themselves, nearly all, are passed on; only the others are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Place of a record: file, split in which it begins, number in that split.
AT = "_at"


def lines_of(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """file, block, place, line, odd (whether the number of quotes in the line is odd)."""
    value = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
        value.alias("line"), (F.length(F.regexp_replace("value", '[^"]', "")) % 2).alias("odd"),
    )


def _before(c: Column, window) -> Column:
    return F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def records_of(lines: DataFrame) -> DataFrame:
    """record (text, lines joined by a line feed) and its place ``AT``, the header of each file included.

    A quote that is never closed makes one record of the rest of its file.
    """
    split, files = Window.partitionBy("file", "block").orderBy("place"), Window.partitionBy("file").orderBy("block")
    blocks = lines.groupBy("file", "block").agg(F.sum("odd").alias("odds")).select("file", "block", (_before(F.col("odds"), files) % 2).alias("open"))
    marked = lines.withColumn("_quotes", _before(F.col("odd"), split)).join(blocks, ["file", "block"])
    marked = marked.withColumn("begins", ((F.col("_quotes") + F.col("open")) % 2 == 0).cast("long"))
    counted = marked.withColumn("number", F.sum("begins").over(split.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Lines ahead of the first beginning of a split go on the last record of an earlier one.
    starts = counted.groupBy("file", "block").agg(F.max("number").alias("starts"))
    own = F.when(F.col("starts") > 0, F.struct("block", F.col("starts").alias("number")))
    last = starts.select("file", "block", F.last(own, ignorenulls=True).over(files.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    placed = counted.join(last, ["file", "block"]).withColumn(
        AT, F.when(F.col("number") > 0, F.struct("file", "block", "number")).otherwise(F.struct("file", F.col("earlier.block").alias("block"), F.col("earlier.number").alias("number")))
    )
    whole = (F.col("begins") == 1) & (F.col("odd") == 0)
    parts = placed.where(~whole).groupBy(AT).agg(F.array_sort(F.collect_list(F.struct("block", "place", "line"))).alias("lines"))
    joined = parts.select(AT, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record"))
    return placed.where(whole).select(AT, F.col("line").alias("record")).unionByName(joined)


def data_records(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """Records without headers and blank lines."""
    first = (F.col(f"{AT}.block") == 0) & (F.col(f"{AT}.number") == 1)
    return records_of(lines_of(spark, files, encoding)).where(~first & (F.trim("record") != ""))
