"""Grounding checks of written reports against their evidence, for many reports at once.

Reports and evidence are JSON documents keyed by ``report_id``; both are flattened to leaves and every check is a
join or a predicate over leaves.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.session import materialize

# Wording that makes a claim hypothetical or a non-assertion, terms and patterns that need it, and
# words that mark a number as measured.
HYPOTHESIS_MARKERS = (
    "hypothesis", "may ", "might ", "could ", "possible", "plausible", "investigate", "validate whether", "suggests",
)
NON_ASSERTION_MARKERS = (
    "no ", "not ", "unknown", "unavailable", "was not supplied", "does not establish", "cannot establish",
)
BUSINESS_TERMS = ("revenue", "retention", "conversion", "churn")
CAUSAL_PHRASES = ("caused by", "due to", "resulted in", "led to", "drive", "drives", "root cause")
MEASURED_WORDS = ("reviews", "feedback", "requests", "mentions", "rating", "score")
UNNUMBERED_PATHS = ("timeframe", "owner", "title")
NUMBER_PATTERN = r"(?<![\p{L}\p{N}_.-])-?\d[\d,]*(?:\.\d+)?[\t-\r ]*%?"
ABSOLUTE_TOLERANCE, RELATIVE_TOLERANCE = 0.011, 0.012


def json_depth(docs: DataFrame, json: str = "document") -> int:
    """An upper bound of the nesting of the documents, from their brackets; brackets inside strings may raise it."""
    brackets = F.split(F.regexp_replace(F.coalesce(F.col(json), F.lit("")), r"[^\[\]{}]+", ""), "")
    step = F.aggregate(
        brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct(
            (s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"),
        ),
    )
    return docs.agg(F.max(step["most"])).first()[0] or 0


def json_leaves(docs: DataFrame, key: str = "report_id", json: str = "document", *, depth: int | None = None) -> DataFrame:
    """Scalar leaves of JSON documents: key, path (``a.b[0].c``), kind (number, string, boolean), value as text.

    One ``variant_explode`` per nesting level; leaves above the last level pass through. Without ``depth`` the levels are
    taken from the documents, so any nesting is read.
    """
    depth = json_depth(docs, json) if depth is None else depth
    nodes = docs.select(F.col(key), F.lit("").alias("_path"), F.try_parse_json(F.col(json)).alias("_v"))
    nested = F.schema_of_variant("_v").rlike("^(ARRAY|OBJECT)")
    for _ in range(depth):
        children = nodes.lateralJoin(docs.sparkSession.tvf.variant_explode_outer(F.when(nested, F.col("_v")).outer()))
        step = (
            F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
            .when(F.col("_path") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key")))
        )
        nodes = children.select(
            F.col(key),
            F.when(nested, F.concat("_path", step)).otherwise(F.col("_path")).alias("_path"),
            F.when(nested, F.col("value")).otherwise(F.col("_v")).alias("_v"),
        )
    kind = F.schema_of_variant("_v")
    too_deep = F.raise_error(F.lit("Nested deeper than the given depth.")).cast("string")
    return nodes.filter(F.col("_v").isNotNull() & (kind != "VOID")).select(
        key, F.col("_path").alias("path"),
        F.when(nested, too_deep).when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number").alias("kind"),
        F.col("_v").cast("string").alias("value"),
    )


def evidence_ids(leaves: DataFrame) -> DataFrame:
    named = F.col("path").endswith("review_id") | F.col("path").contains("review_ids[")
    return leaves.filter(named).select("report_id", F.col("value").alias("review_id")).distinct()


def evidence_numbers(leaves: DataFrame) -> DataFrame:
    counted = (F.col("kind") == "number") & ~F.col("path").endswith(".rank") & ~F.col("path").endswith("source_row_index")
    return leaves.filter(counted).select("report_id", "path", F.col("value").try_cast("double").alias("value"))


def list_records(leaves: DataFrame, section: str, *fields: str) -> DataFrame:
    """Records of a list section put back together from their leaves."""
    path = F.regexp_extract("path", rf"^{section}\[(\d+)\]\.({'|'.join(fields)})$", 1)
    name = F.regexp_extract("path", rf"^{section}\[(\d+)\]\.({'|'.join(fields)})$", 2)
    rows = leaves.select("report_id", path.alias("_i"), name.alias("_f"), "value").filter(F.col("_i") != "")
    return rows.groupBy("report_id", F.col("_i").cast("int").alias("position")).agg(
        *[F.max(F.when(F.col("_f") == f, F.col("value"))).alias(f) for f in fields]
    )


def marker_flags(text: Column) -> dict[str, Column]:
    low = F.lower(text)

    def any_of(markers) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(m) for m in markers])

    causal = low.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(CAUSAL_PHRASES)})(?![\p{{L}}\p{{N}}_])")
    excused = any_of(HYPOTHESIS_MARKERS) | any_of(NON_ASSERTION_MARKERS)
    return {
        "hypothetical": any_of(HYPOTHESIS_MARKERS),
        "non_assertive": any_of(NON_ASSERTION_MARKERS),
        "unsupported_business": any_of(BUSINESS_TERMS) & ~excused,
        "unsupported_causal": causal & ~excused,
    }


def number_claims(claims: DataFrame) -> DataFrame:
    """Every number stated in a claim, with its percent sign and whether the claim speaks of measured things."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(NUMBER_PATTERN), F.lit(0)))
    low = F.lower("text")
    measured = reduce(lambda a, b: a | b, [low.contains(w) for w in MEASURED_WORDS])
    stated = claims.select("report_id", "path", measured.alias("measured"), found.alias("position", "raw"))
    text = F.trim("raw")
    return stated.select(
        "report_id", "path", "position", text.alias("claim"),
        F.regexp_replace("raw", r"[,%\t-\r ]", "").try_cast("double").alias("number"),
        text.endswith("%").alias("is_percent"), "measured",
    )


def number_bucket(x: Column) -> Column:
    """Buckets no wider than the tolerance of the values in them: even steps below 1, then geometric steps."""
    size = F.abs(x)
    step = F.when(size < 1, F.floor(size / ABSOLUTE_TOLERANCE)).otherwise(
        F.floor(F.log(size) / math.log(1 + RELATIVE_TOLERANCE)) + F.floor(F.lit(1 / ABSOLUTE_TOLERANCE)) + 1
    )
    return F.when(x < 0, -step - 1).otherwise(step).cast("long")


def supported_numbers(numbers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stated numbers within tolerance of some evidence number of the same report, as written or as a percentage.

    A range join on value buckets. Tolerance bounds grow with the value, so only the nearest evidence below and above
    a number can support it: the smallest and largest value of each bucket stand for all of it, and a bucket that
    holds a third of all evidence is still one row.
    """
    ends = evidence.filter(F.col("value").isNotNull()).groupBy("report_id", number_bucket(F.col("value")).alias("_bucket")).agg(
        F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    # The evidence is the small side: its buckets are widened, a number keeps one row per reading.
    around = F.explode(F.sequence(F.col("_bucket") - 2, F.col("_bucket") + 2))
    wide = ends.select("report_id", around.alias("_bucket"), "_low", "_high")
    readings = F.explode(F.array(F.col("number"), F.col("number") / 100.0))
    near = numbers.filter(F.col("number").isNotNull()).select("*", readings.alias("_reading"))
    near = near.withColumn("_bucket", number_bucket(F.col("_reading"))).join(wide, ["report_id", "_bucket"])

    def within(source: str) -> Column:
        tolerance = F.greatest(F.lit(ABSOLUTE_TOLERANCE), F.abs(source) * RELATIVE_TOLERANCE)
        return F.abs(F.col("_reading") - F.col(source)) <= tolerance

    return near.filter(within("_low") | within("_high")).select("report_id", "path", "position").distinct()


def unsupported_numbers(numbers: DataFrame, evidence: DataFrame) -> DataFrame:
    kept = numbers.filter(reduce(lambda a, b: a & b, [~F.col("path").endswith(p) for p in UNNUMBERED_PATHS]))
    lacking = kept.join(supported_numbers(kept, evidence), ["report_id", "path", "position"], "left_anti")
    severity = F.when(F.col("is_percent") | F.col("measured"), "error").otherwise("warning")
    return lacking.withColumn("severity", severity)


def check_quotes(citations: DataFrame, quotes: DataFrame) -> DataFrame:
    """Status of each citation: exact, altered, or unavailable where the id has no quote in the evidence."""
    latest = F.max_by("review_text", "position") if "position" in quotes.columns else F.max("review_text")
    known = quotes.groupBy("report_id", "review_id").agg(latest.alias("_source"))
    status = (
        F.when(F.col("_source").isNull(), "unavailable").when(F.col("quote") == F.col("_source"), "exact").otherwise("altered")
    )
    return citations.join(known, ["report_id", "review_id"], "left").withColumn("status", status).drop("_source")


def check_ids(citations: DataFrame, available: DataFrame) -> DataFrame:
    """Distinct cited ids with whether the evidence holds them."""
    cited = citations.select("report_id", "review_id").distinct()
    known = available.select("report_id", "review_id").distinct().withColumn("_known", F.lit(True))
    return cited.join(known, ["report_id", "review_id"], "left").select(
        "report_id", "review_id", F.coalesce("_known", F.lit(False)).alias("is_available")
    )


def invalid_ids(citations: DataFrame, available: DataFrame) -> DataFrame:
    return citations.select("report_id", "review_id").distinct().join(available, ["report_id", "review_id"], "left_anti")


def validated_ids(citations: DataFrame, available: DataFrame) -> DataFrame:
    return citations.select("report_id", "review_id").distinct().join(available, ["report_id", "review_id"], "left_semi")


def validate_reports(reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """All findings: report_id, severity, path, message. A report without an error finding is grounded.

    ``reports`` and ``evidence`` have columns report_id and document. Every check reads the leaves, so they are stored.
    """
    return _findings(reports, materialize(json_leaves(reports)), materialize(json_leaves(evidence)))


def report_results(reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per report: is_valid, errors, warnings, and as sorted lists the cited ids that the evidence holds, those it
    does not hold, and the measured numbers without evidence."""
    said, shown = materialize(json_leaves(reports)), materialize(json_leaves(evidence))
    found = _findings(reports, said, shown).groupBy("report_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    cited, available = _cited_ids(said), evidence_ids(shown)
    numbers = unsupported_numbers(number_claims(_claims(said)), evidence_numbers(shown)).filter("severity = 'error'")
    kinds = {"validated_review_ids": F.lit("validated"), "invalid_review_ids": F.lit("invalid"), "unsupported_metrics": F.lit("metric")}
    values = reduce(DataFrame.unionByName, [
        validated_ids(cited, available).select("report_id", kinds["validated_review_ids"].alias("kind"), F.col("review_id").alias("value")),
        invalid_ids(cited, available).select("report_id", kinds["invalid_review_ids"].alias("kind"), F.col("review_id").alias("value")),
        numbers.select("report_id", kinds["unsupported_metrics"].alias("kind"), F.col("claim").alias("value")).distinct(),
    ])
    # A report cites a few reviews; its lists are as long as its text allows.
    lists = values.groupBy("report_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(name) for name, kind in kinds.items()
    ])
    none = F.array().cast("array<string>")
    joined = reports.select("report_id").distinct().join(found, "report_id", "left").join(lists, "report_id", "left")
    errors, warnings = (F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings"))
    return joined.select(
        "report_id", (F.coalesce("errors", F.lit(0)) == 0).alias("is_valid"), errors, warnings, *[F.coalesce(c, none).alias(c) for c in kinds]
    )


def _claims(said: DataFrame) -> DataFrame:
    return said.filter(F.col("kind") == "string").select("report_id", "path", F.col("value").alias("text"))


def _cited_ids(said: DataFrame) -> DataFrame:
    """Ids that a report refers to, in supporting lists and in its quotes."""
    listed = _claims(said).filter(F.col("path").contains("supporting_review_ids[")).select("report_id", F.col("text").alias("review_id"))
    return listed.unionByName(list_records(said, "evidence", "review_id", "quote").select("report_id", "review_id"))


def _findings(reports: DataFrame, said: DataFrame, shown: DataFrame) -> DataFrame:
    claims = _claims(said)
    references = list_records(said, "evidence", "review_id", "quote")
    cited = _cited_ids(said)
    sources = list_records(shown, "representative_quotes", "review_id", "review_text")

    def finding(df: DataFrame, severity: Column, path: Column, *message: Column | str) -> DataFrame:
        return df.select("report_id", severity.alias("severity"), path.alias("path"), F.concat(*message).alias("message"))

    error, nowhere = F.lit("error"), F.lit(None).cast("string")
    quotes = check_quotes(references, sources).filter(F.col("status") != "exact")
    flagged = claims.withColumns(marker_flags(F.col("text")))
    numbers = unsupported_numbers(number_claims(claims), evidence_numbers(shown))
    limited = said.filter(F.col("path").startswith("confidence_assessment.limitations[")).select("report_id").distinct()
    kind = F.when(F.col("severity") == "error", "No evidence for the measured number '").otherwise("Number without evidence, not clearly measured: '")
    return reduce(DataFrame.unionByName, [
        finding(quotes, error, F.concat(F.lit("evidence["), "position", F.lit("]")), F.lit("Quote of "), "review_id",
                F.when(F.col("status") == "unavailable", " has no source text to compare with.")
                .otherwise(" differs from its source text.")),
        finding(invalid_ids(cited, evidence_ids(shown)).select("report_id").distinct(), error, nowhere,
                F.lit("The report cites reviews that the evidence does not hold.")),
        finding(flagged.filter("unsupported_business"), error, F.col("path"),
                F.lit("Business effect claimed without support in "), "path", F.lit(".")),
        finding(flagged.filter("unsupported_causal"), error, F.col("path"),
                F.lit("Cause claimed without support in "), "path", F.lit(".")),
        finding(numbers, F.col("severity"), F.col("path"), kind, "claim", F.lit("' in "), "path", F.lit(".")),
        finding(reports.select("report_id").distinct().join(limited, "report_id", "left_anti"), error, nowhere,
                F.lit("No limitation is named in the confidence assessment.")),
    ]).distinct()
