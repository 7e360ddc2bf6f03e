"""CSV scan with encoding detection, strict rows, headers aligned by name and missing-value spellings."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedloom.functions.text import nonblank
from feedloom.operators.conform import number_file_rows, number_rows
from feedloom.sources.records import AT, data_records
from feedloom.vocab.columns import NA_TOKENS

RAW = "_raw_record"


@dataclass(frozen=True)
class CsvFile:
    path: str
    encoding: str
    header: tuple[str, ...]
    multi_line: bool


def describe_files(spark: SparkSession, paths: Sequence[str], encoding: str | None = None) -> list[CsvFile]:
    """Encoding, header and whether quoted line breaks occur, for every file, from one parallel pass over the lines.

    UTF-8 where every line is valid UTF-8, else ISO-8859-1. An odd number of quotes in a line means that a quoted value
    goes on in the next one. One row per file comes back to the driver, as it does when Spark lists the files. Another
    ``encoding`` has to write quotes, commas and line ends as ASCII does.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        F.col("value").cast("binary").alias("line"),
        F.is_valid_utf8("value").alias("ok"), nonblank(F.col("value")).alias("used"),
        (F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).alias("open"),
    )
    files = lines.groupBy("path").agg(
        F.bool_and("ok").alias("ok"), F.bool_or("used").alias("used"), F.bool_or("open").alias("open"), F.min_by("line", "at").alias("header")
    ).collect()
    if not any(f["used"] for f in files):
        raise ValueError("The CSV file is empty: it has no header.")
    out = []
    for f in sorted(files, key=lambda f: f["path"]):
        name = encoding or ("UTF-8" if f["ok"] else "ISO-8859-1")
        first = bytes(f["header"]).decode("utf-8-sig" if name.upper() == "UTF-8" else name)
        out.append(CsvFile(f["path"], name, tuple(next(csv.reader([first]), ())), f["open"]))
    return out


def file_warnings(files: Sequence[CsvFile]) -> list[str]:
    """What a reader of the data should know about the files."""
    return [f"{f.path} is not valid UTF-8 and was read as Latin-1." for f in files if f.encoding == "ISO-8859-1"]


def read_feedback_csv(spark: SparkSession, paths: str | Sequence[str], *, encoding: str | None = None,
                      multi_line: bool | None = None, na_tokens: Sequence[str] = NA_TOKENS, max_rows: int | None = None,
                      row_numbers: bool = True) -> DataFrame:
    """Read CSV files as string columns named by their header.

    Files may order their columns differently, but need the same ones. Rows with more fields than the header fail the job
    that reads them; shorter rows are filled with nulls. Files with quoted line breaks are split like others and their lines
    put together, line breaks as line feeds; ``multi_line`` overrides what the lines say. ``max_rows`` rejects a longer input and costs a count; by default
    there is no limit.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not all(p.lower().rstrip("/").endswith(".csv") for p in paths):
        raise ValueError("Only files that end in .csv can be read.")
    files = describe_files(spark, paths, encoding)
    names = files[0].header
    for f in files:
        if sorted(f.header) != sorted(names) or len(set(f.header)) != len(f.header):
            raise ValueError(f"The header of {f.path} has other columns, or one column twice.")
    kinds: dict[tuple, list[str]] = {}
    for f in files:
        kinds.setdefault((f.encoding, f.header, f.multi_line if multi_line is None else multi_line), []).append(f.path)
    parts = [_scan_records(spark, own, *kind[:2]) if kind[2] else _scan(spark, own, *kind[:2]) for kind, own in sorted(kinds.items())]
    if row_numbers:
        out = _numbered(parts)
    else:
        out = reduce(DataFrame.unionByName, [part.drop(AT) for part in parts])
    # Quoted values may hold commas; without them the commas of a record tell its fields.
    fields = F.length(F.regexp_replace(F.regexp_replace(RAW, '"([^"]|"")*"', ""), "[^,]", "")) + 1
    # Naming a field keeps it among the columns read: Spark refuses to read the raw record alone.
    begins = F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))
    too_long = F.raise_error(F.concat(F.lit(f"A row has more fields than the header, which has {len(names)}; it begins with "), begins))
    out = out.filter(F.when(F.col(RAW).isNull() | (fields <= len(names)), F.lit(True)).otherwise(too_long.cast("boolean"))).drop(RAW)
    if na_tokens:
        out = out.withColumns({c: F.when(~F.col(f"`{c}`").isin(*na_tokens), F.col(f"`{c}`")) for c in names})
    _check_size(out, max_rows)
    return out


def _scan(spark: SparkSession, files: list[str], encoding: str, header: tuple[str, ...]) -> DataFrame:
    """Records whose number of fields is not that of the header keep their text in ``RAW``."""
    schema = StructType([StructField(c, StringType()) for c in (*header, RAW)])
    return spark.read.options(
        header="true", encoding=encoding, quote='"', escape='"', enforceSchema="true",
        columnNameOfCorruptRecord=RAW, columnPruning="false",
    ).schema(schema).csv(files)


def _scan_records(spark: SparkSession, files: list[str], encoding: str, header: tuple[str, ...]) -> DataFrame:
    """As ``_scan``, for files with line breaks in quotes: the lines are put together to records first."""
    fields = StructType([StructField(c, StringType()) for c in (*header, RAW)])
    options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": RAW}
    schema = ", ".join(f"`{f.name}` STRING" for f in fields)
    parsed = data_records(spark, files, encoding).select(AT, F.from_csv("record", schema, options).alias("_row"))
    return parsed.select(AT, *[F.col(f"_row.`{f.name}`").alias(f.name) for f in fields])


def _numbered(parts: list[DataFrame]) -> DataFrame:
    """Row numbers per part; a later part continues after the rows of the earlier ones."""
    out, start = None, 2
    for i, part in enumerate(parts):
        numbered = number_rows(part, AT, start=start).drop(AT) if AT in part.columns else number_file_rows(part, start=start)
        out = numbered if out is None else out.unionByName(numbered)
        if i + 1 < len(parts):
            start += part.count()
    return out


def _check_size(df: DataFrame, max_rows: int | None) -> None:
    if df.isEmpty():
        raise ValueError("Below the header the CSV has no rows.")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"The CSV has more rows than the limit of {max_rows:,}; nothing was loaded.")
