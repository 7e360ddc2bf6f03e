"""Date expressions on naive timestamps (TIMESTAMP_NTZ throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import collapse_ws

ISO = r"^\d{4}(-\d{1,2}(-\d{1,2}([ T]\S.*)?)?)?$"
NUMERIC_DATE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"

# The date spellings tried after ISO, month before day where both read.
FORMATS = (
    "yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss", "M/d/yyyy H:mm", "d/M/yyyy H:mm",
    "yyyy/M/d", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy",
)


def parse_timestamp(c: Column) -> Column:
    """Mixed-format text to TIMESTAMP_NTZ; unreadable values are null."""
    text = collapse_ws(c.cast("string"))
    iso = F.when(text.rlike(ISO), text.try_cast("timestamp_ntz"))
    tidy = F.regexp_replace(F.regexp_replace(text, NUMERIC_DATE, "$1/$2/$3"), ",", "")
    tidy = F.when(~text.rlike(ISO) & text.rlike(r"\d"), tidy)
    return F.coalesce(iso, *(F.try_to_timestamp(tidy, F.lit(f)).cast("timestamp_ntz") for f in FORMATS))


def as_timestamp(c: Column, data_type: str) -> Column:
    """Typed dates are cast, strings are parsed."""
    return parse_timestamp(c) if data_type == "string" else c.cast("timestamp_ntz")


def week_ending(d: Column) -> Column:
    """The Monday that closes the week of a date: weeks run Tuesday to Monday."""
    return F.next_day(F.date_sub(d, 1), "MON")


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
