"""Text expressions with Unicode-aware whitespace and word classes.

Spark's ``trim`` strips only spaces and Java's ``\\s`` is ASCII, so the classes are spelled out here and used
everywhere. ``WORD`` leaves combining marks out, which ``(?U)\\w`` would include.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.vocab.requests import REWRITES

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The same characters but the space itself, as a string.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = r"\p{L}\p{N}_"


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(" " + BLANKS))


def collapse_ws(c: Column) -> Column:
    """Runs of whitespace become one space; the ends are trimmed.

    Texts of printable ASCII without two spaces together have nothing to collapse, which one cheap look finds out.
    """
    return F.trim(F.when(c.rlike("[^ -~]|  "), F.regexp_replace(c, f"[{WS}]+", " ")).otherwise(c))


def nonblank(c: Column) -> Column:
    """True for values holding at least one non-whitespace character, false for null."""
    return c.isNotNull() & F.coalesce(c.cast("string").rlike(f"[^{WS}]"), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_ws(c.cast("string")), F.lit(""))


# Any character outside ASCII, the accented Latin-1 letters and the common dashes and quotes. A string without such
# characters is already in NFKC: each of the others is its own normal form and composes with nothing.
MAY_CHANGE = r"[^\x{0}-\x{7f}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}\x{2013}\x{2014}\x{2018}-\x{201f}]"


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Spark has no built-in for it, so the few rows that can change go through one Arrow UDF.

    Rows that are already normalised send a null to the Python worker and keep their JVM value.
    """
    normalise = F.pandas_udf(lambda s: s.str.normalize("NFKC"), StringType())
    # The many ranges are only looked at where a character is not ASCII.
    return F.coalesce(normalise(F.when(c.rlike(f"(?=[^\\x00-\\x7f]){MAY_CHANGE}"), c)), c)


def strip_markup(c: Column) -> Column:
    """Tags, then URLs, become spaces; whitespace is collapsed."""
    no_tags = F.regexp_replace(c, "<[^>]+>", " ")
    no_urls = F.regexp_replace(no_tags, f"https?://[^{WS}]+|www\\.[^{WS}]+", " ")
    return collapse_ws(no_urls)


def clean_text(c: Column, normalise: bool = True) -> Column:
    text = c.cast("string")
    return strip_markup(nfkc(text) if normalise else text)


def rule_text(c: Column) -> Column:
    """Text as the theme rules see it: lower case, single spaces."""
    return collapse_ws(F.lower(c))


def request_text(c: Column, normalise: bool = True) -> Column:
    """Text as the request rules see it: normalised, lower case, spelling rewrites, no punctuation."""
    out = F.lower(nfkc(c) if normalise else c)
    spelled = F.translate(out, "’–—", "'--")
    patterns = [(wrong.replace(r"\s", WS), right) for wrong, right in REWRITES]
    for pattern, right in patterns:
        # The first letter is looked at before what stands in front of it.
        spelled = F.regexp_replace(spelled, f"(?={pattern[0]})(?<![{WORD}])(?:{pattern})(?![{WORD}])", right)
    # ASCII texts that hold none of the spellings stay as they are; one look finds that out.
    first = "".join(sorted({pattern[0] for pattern, _ in patterns}))
    changes = out.rlike(f"[^\\x00-\\x7f]|(?=[{first}])(?:{'|'.join(pattern for pattern, _ in patterns)})")
    # Whitespace is no word character: runs of anything else become one space.
    return F.trim(F.regexp_replace(F.when(changes, spelled).otherwise(out), f"[^{WORD}]+", " "))
