"""Metrics, trends, segments, quotes, releases, evidence, grounding."""

import json
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.operators import contracts, evidence, grounding, grouping, metrics, quotes, releases, segments, trends, views
from feedloom.operators.filters import apply_filters
from feedloom.plans import CubeTables, aggregate
from feedloom.streaming import stream_enriched


def series(spark, days, sentiment=lambda i: "Negative", theme=lambda i: "Payment and Checkout"):
    start = datetime(2025, 1, 1)
    rows = [(f"R{i:03}", start + timedelta(days=i, hours=5), sentiment(i), theme(i), 3.0) for i in range(days)]
    return spark.createDataFrame(rows, "review_id string, date timestamp_ntz, sentiment string, primary_theme string, rating double")


def test_short_coverage_is_neutral(spark):
    rows = trends.theme_trends(trends.day_theme_volume(series(spark, 7))).collect()
    assert [(r["recent_count"], r["growth_rate"], r["trend_score"]) for r in rows] == [(0, 0.0, 50.0)]
    assert trends.fastest_growing(trends.theme_trends(trends.day_theme_volume(series(spark, 7)))).isEmpty()


def test_growth_is_bounded_and_names_the_fastest(spark):
    df = series(spark, 30, theme=lambda i: "App Performance" if i >= 15 else "Delivery Experience")
    rows = {r["theme"]: r for r in trends.theme_trends(trends.day_theme_volume(df)).collect()}
    assert rows["App Performance"]["growth_rate"] == 1.0 and rows["App Performance"]["trend_score"] == 100.0
    assert rows["Delivery Experience"]["growth_rate"] == pytest.approx(-13 / 14)
    assert trends.fastest_growing(trends.theme_trends(trends.day_theme_volume(df))).first()[0] == "App Performance"


def test_weeks_fill_gaps(spark):
    df = series(spark, 30).filter("day(date) < 3 OR day(date) > 20")
    weeks = trends.weekly_volume(trends.day_theme_volume(df)).orderBy("week").collect()
    assert [r["feedback_count"] for r in weeks].count(0) == 2 and all((r["negative_percentage"] is None) == (r["feedback_count"] == 0) for r in weeks)


def test_summary_bounds_and_shares(analyzed):
    rows = metrics.summarize_themes(analyzed).collect()
    assert sum(r["share_percentage"] for r in rows) == pytest.approx(100)
    assert all(0 <= r[c] <= 100 for r in rows for c in ("severity_score", "priority_score", "trend_score"))
    overall = metrics.overall_metrics(analyzed, metrics.summarize_themes(analyzed)).first()
    parts = [overall[f"{s}_feedback_percentage"] for s in ("positive", "neutral", "negative")]
    assert sum(parts) == pytest.approx(100)


def test_rare_critical_floor(spark):
    df = spark.createDataFrame([(90.0, 0.0, 3.0, 50.0, True), (90.0, 0.0, 3.0, 50.0, False)],
                               "frequency_component double, negative_percentage double, average_rating double, trend_score double, rare_critical boolean")
    df = df.withColumns({"critical_component": F.lit(0.0), "business_risk": F.lit("Trust risk"), "average_confidence": F.lit(0.5)})
    rare, common = metrics.severity_and_priority(df).orderBy(F.desc("rare_critical")).collect()
    assert rare["severity_score"] == 70.0 and rare["priority_score"] >= 60.0 and "safeguard" in rare["priority_explanation"]
    assert common["severity_score"] < 70.0 and rare["priority_label"] == "P1 High"


def test_unknown_theme_and_null_theme_have_no_critical_rows(spark):
    df = series(spark, 3, theme=lambda i: None).withColumn("clean_text", F.lit("this is a scam"))
    row = metrics.summarize_themes(df).first()
    assert row["theme"] is None and row["critical_count"] == 0 and row["business_risk"] == "Customer satisfaction risk"


def test_filters(analyzed):
    assert apply_filters(analyzed, None).count() == analyzed.count()
    assert apply_filters(analyzed, {"platform": [], "no_such": ["x"]}).count() == analyzed.count()
    day = apply_filters(analyzed, {"date_range": ("2024-01-05", "2024-01-05")})
    whole = apply_filters(analyzed, {"date_range": ("2024-01-05", "2024-01-05")}, inclusive_end_day=True)
    assert day.count() == 0 < whole.count()


def test_quotes_are_unique_limited_and_grounded(analyzed):
    found = quotes.representative_quotes(analyzed)
    rows = found.collect()
    assert len({(r["primary_theme"], r["original_text"].strip()) for r in rows}) == len(rows) and max(r["rank"] for r in rows) <= 5
    assert quotes.ungrounded_quotes(found, analyzed).isEmpty()


def _greedy(rows, groups):
    """Straightforward reading of the rule, to check the operator against."""
    ids, texts, picked = set(), set(), []
    for kind, key in groups:
        column = "primary_theme" if kind == "pain_point" else "feature_request_group"
        own = [r for r in rows if r[column] == key]
        order = (lambda r: (-(r["sentiment"] == "Negative"), -r["classification_confidence"], r["review_id"], r["source_row_number"])) if kind == "pain_point" else (
            lambda r: (-r["feature_request_confidence"], r["review_id"], r["source_row_number"]))
        for r in sorted(own, key=order):
            if r["review_id"] not in ids and r["original_text"] not in texts and r["original_text"].strip():
                ids.add(r["review_id"])
                texts.add(r["original_text"])
                picked.append((r["review_id"], r["original_text"]))
                break
    return picked


@pytest.mark.parametrize("depth", [1, 50])
def test_unique_quotes_match_brute_force(spark, analyzed, depth):
    """Few ids and texts repeated over many groups, so early picks block later ones."""
    df = analyzed.withColumns({"review_id": F.concat(F.lit("id"), F.col("source_row_number") % 9), "original_text": F.concat(F.lit("t"), F.col("source_row_number") % 11)})
    groups = [("pain_point", "App Performance"), ("pain_point", "Delivery Experience"), ("pain_point", "Payment and Checkout"), ("feature_request", "Card Controls")]
    frame = spark.createDataFrame([(k, g, i) for i, (k, g) in enumerate(groups)], "kind string, key string, position int")
    got = quotes.unique_quote_evidence(df, frame, depth=depth).orderBy("rank").collect()
    assert [(r["quote"]["review_id"], r["quote"]["review_text"]) for r in got] == _greedy(df.collect(), groups)


def test_versions_sort_by_number_and_releases_fill(spark):
    df = spark.createDataFrame([("3.10.0",), ("3.9.0",), ("beta",), ("3",)], "v string")
    assert [r[0] for r in df.orderBy(releases.version_key(F.col("v"))).collect()] == ["beta", "3", "3.9.0", "3.10.0"]
    rows = series(spark, 60)
    calendar = spark.sql("SELECT DATE '2025-01-03' AS released, 'a' AS version UNION ALL SELECT DATE '2025-02-10', 'b' UNION ALL SELECT NULL, 'z'")
    found = dict(map(tuple, releases.fill_release(rows, calendar).select("review_id", "expected_version").collect()))
    assert found["R000"] is None and found["R002"] == "a" and found["R059"] == "b"


def test_releases_of_one_day_and_long_calendars(spark):
    """Three thousand days with three releases each, against a plain search."""
    calendar = spark.range(9000).select(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") / 3).cast("int")).alias("released"), F.format_string("v%d", F.col("id") % 3).alias("version"))
    rows = spark.range(0, 4000, 13).select("id", F.date_add(F.lit("1999-12-01").cast("date"), F.col("id").cast("int")).alias("date"))
    found = {r["id"]: r["expected_version"] for r in releases.fill_release(rows, calendar).collect()}
    assert found == {i: (None if i < 31 else "v2") for i in range(0, 4000, 13)}


def test_context_budget(analyzed):
    rows = evidence.context_rows(analyzed, generated_at="2024-02-01T00:00:00+00:00")
    full = json.loads(evidence.assemble(rows).first()[0])
    assert list(full) == sorted(full) and full["dataset"]["total_cleaned_reviews"] == analyzed.count()
    assert full["top_pain_points"][0]["rank"] == 1 and full["limitations"] and full["data_quality"]["notes"]
    size = len(json.dumps(full, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    small = evidence.compact_insight_context(rows, max_characters=size - 500).first()
    kept = json.loads(small["context_json"])
    assert small["fits"] and small["truncation_applied"] and small["character_count"] <= size - 500
    assert len(kept["representative_quotes"]) < len(full["representative_quotes"]) and kept["release_stories"] == full["release_stories"]
    same = evidence.compact_insight_context(rows, max_characters=10**6).first()
    assert json.loads(same["context_json"]) == full and not same["truncation_applied"]
    assert not evidence.compact_insight_context(rows, max_characters=100).first()["fits"]
    assert len(small["context_fingerprint"]) == 64
    assert len({q["review_id"] for q in full["representative_quotes"]}) == len(full["representative_quotes"])


def report(**changes):
    item = {"rank": 1, "title": "T", "problem_summary": "Seen in 120 reviews", "affected_users": "All", "measured_evidence": "E", "severity": "High",
            "urgency": "Monitor", "confidence": "High", "supporting_review_ids": ["R1"], "limitations": "L"}
    chance = {"rank": 1, "title": "T", "user_problem": "P", "supporting_demand": "D", "affected_segments": "A", "likely_product_impact_hypothesis": "May help",
              "confidence": "Low", "supporting_review_ids": ["R1"], "suggested_validation_step": "S", "limitations": "L"}
    action = {"rank": 1, "action": "A", "rationale": "R", "evidence_summary": "E", "owner": "O", "timeframe": "30 days", "confidence": "High",
              "supporting_review_ids": ["R1"], "limitations": "L"}
    document = {"executive_summary": "Mixed", "customer_problems": [item], "product_opportunities": [chance], "release_risks": [], "recommended_actions": [action],
                "evidence": [{"review_id": "R1", "quote": "Exact text"}], "confidence_assessment": {"overall_confidence": "High", "evidence_strengths": ["E"], "limitations": ["L"]}}
    document.update(changes)
    return json.dumps(document)


EVIDENCE = json.dumps({"representative_quotes": [{"review_id": "R1", "review_text": "Exact text"}], "total": 120, "share": 0.25})


def test_report_findings(spark):
    cases = {
        "good": report(), "causal": report(executive_summary="Fell due to the update"), "hedged": report(executive_summary="May be due to the update"),
        "number": report(executive_summary="77% of reviews"), "percent": report(executive_summary="25% of reviews"), "vague": report(executive_summary="About 55 things"),
        "quote": report(evidence=[{"review_id": "R1", "quote": "Changed"}]), "id": report(evidence=[{"review_id": "R9", "quote": "x"}]),
        "business": report(executive_summary="Churn rises"),
    }
    docs = spark.createDataFrame(list(cases.items()), "report_id string, document string")
    shown = spark.createDataFrame([(k, EVIDENCE) for k in cases], "report_id string, document string")
    found = grounding.validate_reports(docs, shown).collect()
    errors = {k: sorted(r["message"] for r in found if r["report_id"] == k and r["severity"] == "error") for k in cases}
    assert not errors["good"] and not errors["hedged"] and not errors["percent"] and not errors["vague"]
    assert "Cause claimed" in errors["causal"][0] and "measured number '77%'" in errors["number"][0] and "Business effect" in errors["business"][0]
    assert "differs from its source" in errors["quote"][0] and len(errors["id"]) == 2
    assert [r["message"] for r in found if r["report_id"] == "vague"] == ["Number without evidence, not clearly measured: '55' in executive_summary."]
    results = {r["report_id"]: r for r in grounding.report_results(docs, shown).collect()}
    assert {k: r["is_valid"] for k, r in results.items()} == {k: not errors[k] for k in cases}
    assert {k: r["errors"] for k, r in results.items()} == {k: len(errors[k]) for k in cases} and results["vague"]["warnings"] == 1
    assert results["good"]["validated_review_ids"] == ["R1"] and results["good"]["invalid_review_ids"] == [] == results["good"]["unsupported_metrics"]
    assert results["id"]["invalid_review_ids"] == ["R9"] and results["number"]["unsupported_metrics"] == ["77%"]


def test_contract(spark):
    bad = json.loads(report())
    bad["customer_problems"][0].update(rank=0, severity="Huge", supporting_review_ids=["R1", " R1 "], extra=1)
    bad["recommended_actions"] = []
    docs = spark.createDataFrame([("good", report()), ("bad", json.dumps(bad)), ("broken", "no json")], "report_id string, document string")
    found = {tuple(r) for r in contracts.contract_violations(docs).collect()}
    assert found == {
        ("bad", "customer_problems[0].rank", "below minimum"), ("bad", "customer_problems[0].severity", "not an allowed value"),
        ("bad", "customer_problems[0].supporting_review_ids", "repeated item"), ("bad", "customer_problems[0].extra", "unknown field"),
        ("bad", "recommended_actions", "too few items"), ("broken", "", "not a JSON object"),
    }


def test_aggregate_and_views(analyzed):
    result = aggregate(analyzed)
    assert result.daily.count() == 30 and result.overall.count() == 1
    assert views.executive_view(result.themes).columns[0] == "Theme"
    assert views.pain_point_view(result.themes).agg(F.min("Rank")).first()[0] == 1


def test_stream_matches_batch(spark, feedback, analyzed, tmp_path):
    feedback.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feedback.schema).parquet(str(tmp_path / "in"))
    stream_enriched(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.groupBy("primary_theme").count().exceptAll(analyzed.groupBy("primary_theme").count()).isEmpty() and out.count() == analyzed.count()


def test_cubes_of_batches_equal_all_rows(spark, feedback, analyzed, tmp_path):
    """Batches in any cut add up to the whole; a batch given twice counts once; each batch is read and enriched once."""
    tables = CubeTables(spark, str(tmp_path / "cubes"))
    part = F.col("source_row_number") % 4
    tables.add("2024-01", feedback.where(part == 0))
    half = tables.themes().agg(F.sum("frequency")).first()[0]
    assert half == feedback.where(part == 0).count()
    tables.add("7", feedback.where(part.isin(1, 2)))
    tables.add("7", feedback.where(part.isin(1, 2)))
    tables.add("07", feedback.where(part == 3))
    tables.add("none", feedback.limit(0))
    result = aggregate(analyzed)

    def same(a, b):
        order = sorted(a.columns)
        rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(a.dtypes)]
        assert sorted(map(str, a.select(rounded).collect())) == sorted(map(str, b.select(order).select(rounded).collect()))

    same(tables.themes(), result.themes)
    same(tables.weekly(), result.weekly)
    same(tables.daily(), result.daily)
    same(tables.trends(), result.trends)
    same(tables.segments(), segments.segment_insights(analyzed))
    plan = tables.themes()._jdf.queryExecution().executedPlan().toString()
    assert "events" not in plan and "ArrowEvalPython" not in plan


def test_a_batch_is_seen_when_complete(spark, feedback, tmp_path):
    tables = CubeTables(spark, str(tmp_path / "cubes"))
    tables.add("a", feedback.limit(50))
    feedback.limit(20).transform(lambda df: spark.createDataFrame([], tables.cube("volume").schema)).write.parquet(str(tmp_path / "cubes/volume/batch=batch-b"))
    tables.cube("volume").write.parquet(str(tmp_path / "cubes/volume/batch=batch-c"))
    assert tables.volume().agg(F.sum("feedback_count")).first()[0] == feedback.limit(50).where("date IS NOT NULL").count()


def brute_quotes(rows, groups, limit=16):
    """One row per group in order, ids and texts never twice."""
    ids, texts, out = set(), set(), []
    for position, kind, key in sorted(groups):
        own = [r for r in rows if (r["primary_theme"] if kind == "pain_point" else r["feature_request_group"]) == key and (r["original_text"] or "").strip()]
        own.sort(key=lambda r: (-(kind == "pain_point" and r["sentiment"] == "Negative"), -(r["classification_confidence" if kind == "pain_point" else "feature_request_confidence"]), r["review_id"], r["source_row_number"]))
        best = next((r for r in own if r["review_id"] not in ids and r["original_text"] not in texts), None)
        if best:
            ids.add(best["review_id"])
            texts.add(best["original_text"])
            out.append((len(out) + 1, best["review_id"]))
    return out[:limit]


def test_quotes_of_open_segments_do_not_touch_others(spark, analyzed):
    """With a depth of one, segments whose first choices clash are open and resolved in full; all equal brute force."""
    rows = analyzed.withColumn("original_text", F.when(F.col("platform") == "Web", F.concat("primary_theme", F.lit("!"))).otherwise(F.col("original_text")))
    rows = rows.withColumn("platform", F.coalesce("platform", F.lit("none")))
    themes = ["Payment and Checkout", "App Performance", "Delivery Experience", "Feature Request"]
    wanted = [(p, t) for p in ("Web", "iOS", "Android", "none") for t in enumerate(themes, start=1)]
    groups = spark.createDataFrame([(p, "pain_point", t, n) for p, (n, t) in wanted], "platform string, kind string, key string, position int")
    held = [r.asDict() for r in rows.collect()]
    for depth in (1, 50):
        got = quotes.unique_quote_evidence(rows, groups, ["platform"], depth=depth).collect()
        for platform in ("Web", "iOS", "Android", "none"):
            own = sorted((r["rank"], r["quote"]["review_id"]) for r in got if r["platform"] == platform)
            assert own == brute_quotes([r for r in held if r["platform"] == platform], [(n, "pain_point", t) for n, t in enumerate(themes, start=1)])


def test_lists_are_ordered_limited_and_empty_where_nothing_is(spark):
    df = spark.createDataFrame([("g", v, None) for v in ("b", " a", "a ", "", None, "c")] + [(None, "z", None), ("e", " ", None)], "k string, v string, w string")
    keys = df.select("k").distinct()
    got = {r["k"]: (r["lists"], r["others"]) for r in grouping.with_lists(keys, df, ["k"], {"lists": F.col("v"), "others": F.col("w")}, limit=2).collect()}
    assert got == {"g": (["a", "b"], []), None: (["z"], []), "e": ([], [])}
    rows = {(r["k"], r["value"], r["rows"]) for r in grouping.distinct_values(df, ["k"], {"lists": F.col("v")}).collect()}
    assert rows == {("g", "a", 2), ("g", "b", 1), ("g", "c", 1), (None, "z", 1)}


@pytest.mark.parametrize("by", [[], ["country"]])
def test_pain_records_name_every_platform_and_version(spark, by):
    """Themes with more than a thousand platforms and versions, against plain Python; values come twice, with blanks around."""
    themes = ("Payment and Checkout", "App Performance")
    made = [(themes[i % 2], f" P{i * 7 % 2600} " if i % 3 else f"P{i * 7 % 2600}", f"{i % 5000}.0" if i % 11 else " ", f"C{i % 3}") for i in range(9000)]
    rows = series(spark, 9000, theme=lambda i: made[i][0]).join(spark.createDataFrame(
        [(f"R{i:03}", *m[1:], "text") for i, m in enumerate(made)], "review_id string, platform string, app_version string, country string, clean_text string"
    ), "review_id")
    expected = {}
    for theme, platform, version, country in made:
        platforms, versions = expected.setdefault((country if by else None, theme), (set(), set()))
        platforms.add(platform.strip())
        versions.update(filter(None, [version.strip()]))
    assert by or min(len(values) for lists in expected.values() for values in lists) > 1000
    got = evidence.pain_records(rows, metrics.summarize_themes(rows, by), by).collect()
    assert len(got) == 3 * len(expected)
    for r in got:
        platforms, versions = expected[r["country"] if by else None, r["theme"]]
        assert r["affected_platforms"] == sorted(platforms) and r["affected_versions"] == sorted(versions)


@pytest.mark.parametrize("values", [[], [None], [9.0, 0.0], [3.0], [1.5, 2.5], [1.0, 1.0, 5.0], [1.0, 2.0, 2.0, 4.0], [None, 5.0, 4.25, 1.125, 4.25]])
def test_median_of_value_counts(spark, values):
    row = segments.rating_summary(spark.createDataFrame([(v,) for v in values], "rating double").repartition(3)).first()
    valid = [v for v in values if v is not None and 1 <= v <= 5]
    assert row["median_rating"] == (round(statistics.median(valid), 4) if valid else None)
    assert sum(row[f"{n}_star_count"] for n in ("one", "two", "three", "four", "five")) == len(valid)
