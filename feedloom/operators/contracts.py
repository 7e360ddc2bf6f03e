"""Structured-record contracts: JSON documents checked against field rules, as a table of violations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import nonblank, trim_ws


@dataclass(frozen=True)
class Field:
    """Rules of one field. ``kind`` is text, number, integer, boolean or list (of strings)."""

    kind: str = "text"
    required: bool = True
    max_length: int | None = None
    choices: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    min_items: int = 0
    max_items: int | None = None
    unique_items: bool = False


@dataclass(frozen=True)
class Section:
    """A list of records in a document; ``rank`` names the field whose values must not repeat."""

    fields: Mapping[str, Field]
    min_items: int = 0
    max_items: int | None = None
    rank: str | None = None


@dataclass(frozen=True)
class Contract:
    sections: Mapping[str, Section]
    fields: Mapping[str, Field] = field(default_factory=dict)
    objects: Mapping[str, Mapping[str, Field]] = field(default_factory=dict)


_CONFIDENCE = Field(choices=("High", "Medium", "Low"))
_SEVERITY = Field(choices=("Critical", "High", "Medium", "Low"))
_URGENCY = Field(choices=("Immediate", "Near term", "Monitor"))
_IDS = Field(kind="list", min_items=1, max_items=6, unique_items=True)
_RANK = Field(kind="integer", low=1)


def _text(limit: int) -> Field:
    return Field(max_length=limit)


# Sections, fields and bounds of an executive report document.
EXECUTIVE_REPORT = Contract(
    fields={"executive_summary": _text(2_000)},
    sections={
        "customer_problems": Section({
            "rank": _RANK, "title": _text(120), "problem_summary": _text(800), "affected_users": _text(400),
            "measured_evidence": _text(600), "severity": _SEVERITY, "urgency": _URGENCY, "confidence": _CONFIDENCE,
            "supporting_review_ids": _IDS, "limitations": _text(500),
        }, 1, 5, "rank"),
        "product_opportunities": Section({
            "rank": _RANK, "title": _text(120), "user_problem": _text(700), "supporting_demand": _text(600),
            "affected_segments": _text(400), "likely_product_impact_hypothesis": _text(600), "confidence": _CONFIDENCE,
            "supporting_review_ids": _IDS, "suggested_validation_step": _text(600), "limitations": _text(500),
        }, 1, 5, "rank"),
        "release_risks": Section({
            "rank": _RANK, "title": _text(120), "observed_change": _text(700), "affected_platform_or_segment": _text(400),
            "severity": _SEVERITY, "urgency": _URGENCY, "confidence": _CONFIDENCE, "supporting_review_ids": _IDS,
            "hypotheses": _text(600), "recommended_investigation": _text(600), "limitations": _text(500),
        }, 0, 5, "rank"),
        "recommended_actions": Section({
            "rank": _RANK, "action": _text(500), "rationale": _text(700), "evidence_summary": _text(600),
            "owner": _text(120), "timeframe": _text(120), "confidence": _CONFIDENCE, "supporting_review_ids": _IDS,
            "limitations": _text(500),
        }, 1, 7, "rank"),
        "evidence": Section({"review_id": _text(120), "quote": _text(1_500)}, 1, 20),
    },
    objects={"confidence_assessment": {
        "overall_confidence": _CONFIDENCE,
        "evidence_strengths": Field(kind="list", min_items=1, max_items=6),
        "limitations": Field(kind="list", min_items=1, max_items=8),
    }},
)


def _checks(values: Column, name: str, rule: Field) -> list[tuple[Column, str]]:
    """(failing, rule name) pairs of one field of a map<string,string> record."""
    value = values[name]
    missing = ~F.map_contains_key(values, name) | value.isNull()
    checks = [(missing, "missing")] if rule.required else []
    present = ~missing
    if rule.kind == "list":
        items = F.from_json(value, "array<string>")
        tidy = F.transform(items, trim_ws)
        checks += [
            (present & items.isNull(), "not a list"),
            (present & (F.size(items) < rule.min_items), "too few items"),
            (present & F.exists(items, lambda i: ~nonblank(i)), "blank item"),
        ]
        if rule.max_items is not None:
            checks.append((present & (F.size(items) > rule.max_items), "too many items"))
        if rule.unique_items:
            checks.append((present & (F.size(F.array_distinct(tidy)) < F.size(items)), "repeated item"))
    elif rule.kind in ("number", "integer"):
        number = value.try_cast("double")
        checks.append((present & number.isNull(), "not a number"))
        if rule.kind == "integer":
            checks.append((present & (number != F.floor(number)), "not a whole number"))
        if rule.low is not None:
            checks.append((present & (number < rule.low), "below minimum"))
        if rule.high is not None:
            checks.append((present & (number > rule.high), "above maximum"))
    elif rule.kind == "boolean":
        checks.append((present & ~F.lower(value).isin("true", "false"), "not a boolean"))
    else:
        checks.append((present & ~nonblank(value), "blank"))
        if rule.max_length is not None:
            checks.append((present & (F.length(value) > rule.max_length), "too long"))
        if rule.choices:
            checks.append((present & nonblank(value) & ~value.isin(*rule.choices), "not an allowed value"))
    return checks


def _violations(records: DataFrame, key: str, fields: Mapping[str, Field]) -> DataFrame:
    """Violations of (key, path, record map) rows, all fields in one pass."""
    record = F.col("record")
    found = [
        F.when(failing, F.struct(F.lit(name).alias("field"), F.lit(label).alias("rule")))
        for name, rule in fields.items() for failing, label in _checks(record, name, rule)
    ]
    unknown = F.transform(
        F.array_except(F.map_keys(record), F.array(*[F.lit(n) for n in fields])),
        lambda k: F.struct(k.alias("field"), F.lit("unknown field").alias("rule")),
    )
    broken = F.concat(F.array_compact(F.array(*found)), F.coalesce(unknown, F.array().cast("array<struct<field:string,rule:string>>")))
    rows = records.select(key, "path", F.explode(broken).alias("v"))
    return rows.select(key, F.concat_ws(".", F.nullif("path", F.lit("")), "v.field").alias("path"), "v.rule")


def contract_violations(docs: DataFrame, contract: Contract = EXECUTIVE_REPORT, key: str = "report_id",
                        json: str = "document") -> DataFrame:
    """Every broken rule of every document: key, path, rule. Documents without rows meet the contract."""
    parsed = docs.select(key, F.from_json(F.col(json), "map<string,string>").alias("record"))
    top = parsed.withColumn("path", F.lit(""))
    known = {
        **contract.fields, **{n: Field(kind="json") for n in contract.objects},
        **{n: Field(kind="json", required=s.min_items > 0) for n, s in contract.sections.items()},
    }
    unreadable = parsed.filter(F.col("record").isNull()).select(key, F.lit("").alias("path"), F.lit("not a JSON object").alias("rule"))
    parts = [unreadable, _violations(top.filter(F.col("record").isNotNull()), key, known)]
    for name, fields in contract.objects.items():
        inner = parsed.select(key, F.lit(name).alias("path"), F.from_json(F.col("record")[name], "map<string,string>").alias("record"))
        parts.append(_violations(inner.filter(F.col("record").isNotNull()), key, fields))
    for name, section in contract.sections.items():
        lists = parsed.select(key, F.from_json(F.col("record")[name], "array<map<string,string>>").alias("items"))
        size = F.coalesce(F.size("items"), F.lit(0))
        sized = [(size < section.min_items, "too few items")]
        if section.max_items is not None:
            sized.append((size > section.max_items, "too many items"))
        if section.rank:
            ranks = F.transform("items", lambda r: r[section.rank])
            sized.append((F.size(F.array_distinct(ranks)) < F.size(ranks), "repeated rank"))
        broken = F.array_compact(F.array(*[F.when(failing, F.lit(label)) for failing, label in sized]))
        parts.append(lists.filter(F.col("items").isNotNull()).select(key, F.lit(name).alias("path"), F.explode(broken).alias("rule")))
        items = lists.select(key, F.posexplode("items").alias("i", "record"))
        items = items.select(key, F.concat(F.lit(name + "["), F.col("i").cast("string"), F.lit("]")).alias("path"), "record")
        parts.append(_violations(items, key, section.fields))
    return reduce(DataFrame.unionByName, parts)
