"""Queries of the grounding checks: claims, citations and numbers against evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixture import FEEDBACK_CTES, feedback, table
from catalog.queries import STAMP, stored
from catalog.registry import query
from feedloom.operators import contracts, evidence, grounding
from feedloom.session import materialize

# Sentences about each country built from its own figures; every third report misstates them.
CLAIMS_CTES = FEEDBACK_CTES + """,
figures AS (SELECT country AS report_id, count(*) AS n, count(*) FILTER (rating <= 2) AS low, avg(rating) AS mean FROM feedback GROUP BY 1),
stated AS (SELECT report_id, 'summary' AS path, 'Of ' || n || ' reviews, ' || CAST(CASE WHEN n % 3 = 0 THEN floor(100.0 * low / n) + 7 ELSE floor(100.0 * low / n) END AS BIGINT) || '% gave one or two stars' AS text FROM figures
  UNION ALL SELECT report_id, 'action.timeframe', 'Within 30 days' FROM figures
  UNION ALL SELECT report_id, 'detail', 'We saw about ' || (n + CASE WHEN n % 3 = 1 THEN 50 ELSE 0 END) || ' rows in 1,234 hours' FROM figures),
shown AS (SELECT report_id, CAST(n AS DOUBLE) AS value FROM figures UNION ALL SELECT report_id, floor(100.0 * low / n) / 100 FROM figures UNION ALL SELECT report_id, mean FROM figures)"""


def figures(spark, sf_dir):
    return feedback(spark, sf_dir).groupBy(F.col("country").alias("report_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("rating") <= 2).alias("low"), F.avg("rating").alias("mean")
    )


def stated(spark, sf_dir):
    n, low = F.col("n"), F.floor(F.col("low") * 100.0 / F.col("n"))
    share = F.when(n % 3 == 0, low + 7).otherwise(low).cast("string")
    sentences = F.explode(F.array(
        F.struct(F.lit("summary").alias("path"), F.concat(
            F.lit("Of "), n.cast("string"), F.lit(" reviews, "), share, F.lit("% gave one or two stars")).alias("text")),
        F.struct(F.lit("action.timeframe").alias("path"), F.lit("Within 30 days").alias("text")),
        F.struct(F.lit("detail").alias("path"), F.concat(
            F.lit("We saw about "), (n + F.when(n % 3 == 1, 50).otherwise(0)).cast("string"), F.lit(" rows in 1,234 hours")).alias("text")),
    ))
    return figures(spark, sf_dir).select("report_id", sentences.alias("s")).select("report_id", "s.*")


def shown(spark, sf_dir):
    low = F.floor(F.col("low") * 100.0 / F.col("n")) / 100
    values = F.explode(F.array(F.col("n").cast("double"), low, F.col("mean")))
    return figures(spark, sf_dir).select("report_id", values.alias("value"))


_NUMBER_SQL = """SELECT report_id, path, CAST(position - 1 AS INT) AS position, m AS claim, CAST(replace(replace(trim(replace(m, '%', '')), ',', ''), ' ', '') AS DOUBLE) AS number, m LIKE '%\\%' ESCAPE '\\' AS is_percent,
  regexp_matches(lower(text), 'reviews|feedback|requests|mentions|rating|score') AS measured FROM (
  SELECT report_id, path, text, unnest(l) AS m, generate_subscripts(l, 1) AS position FROM (
    SELECT *, regexp_extract_all(replace(text, '%', '% '), '(?:^|[^\\p{L}\\p{N}_.-])(-?\\d[\\d,]*(?:\\.\\d+)?(?:\\s*%)?)', 1) AS l FROM stated))"""


@query("number_claims", CLAIMS_CTES, _NUMBER_SQL, "number")
def _(spark, sf_dir):
    return grounding.number_claims(stated(spark, sf_dir))


@query("unsupported_numbers", CLAIMS_CTES + f", numbers AS ({_NUMBER_SQL})", """SELECT report_id, path, position, claim, CASE WHEN is_percent OR measured THEN 'error' ELSE 'warning' END AS severity FROM numbers n
  WHERE NOT regexp_matches(path, '(timeframe|owner|title)$') AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.report_id = n.report_id AND (abs(n.number - s.value) <= greatest(0.011, 0.012 * abs(s.value))
    OR abs(n.number / 100 - s.value) <= greatest(0.011, 0.012 * abs(s.value))))""")
def _(spark, sf_dir):
    numbers = grounding.number_claims(stated(spark, sf_dir))
    return grounding.unsupported_numbers(numbers, shown(spark, sf_dir)).select("report_id", "path", "position", "claim", "severity")


@query("price_range_join", """prices AS (SELECT l_suppkey AS report_id, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS number FROM lineitem),
parts AS (SELECT DISTINCT l.l_suppkey AS report_id, p.p_retailprice AS value FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)""",
"""SELECT count(*) AS lines, count(*) FILTER (EXISTS (SELECT 1 FROM parts p WHERE p.report_id = x.report_id AND (abs(x.number - p.value) <= greatest(0.011, 0.012 * abs(p.value)) OR abs(x.number / 100 - p.value) <= greatest(0.011, 0.012 * abs(p.value))))) AS supported FROM prices x""")
def _(spark, sf_dir):
    """The tolerance join on real numbers: unit prices of a supplier's lines against the list prices of its parts."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("report_id"), "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("number"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("value"))
    line = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("number").cast("string"))
    prices = lines.select("report_id", line.alias("path"), F.col("l_linenumber").alias("position"), "number")
    found = grounding.supported_numbers(prices, lines.select("report_id", "l_partkey").join(part, "l_partkey"))
    marked = prices.join(found.withColumn("_found", F.lit(True)), ["report_id", "path", "position"], "left")
    return marked.agg(F.count("*").alias("lines"), F.count_if(F.coalesce("_found", F.lit(False))).alias("supported"))


def _any(words) -> str:
    return " OR ".join(f"contains(low, '{w}')" for w in words)


_EXCUSED = f"({_any(grounding.HYPOTHESIS_MARKERS)} OR {_any(grounding.NON_ASSERTION_MARKERS)})"


@query("marker_claims", f"texts AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT CAST(-1 AS BIGINT), event_id, CASE event_id % 6 WHEN 0 THEN 'Churn is due to ' WHEN 1 THEN 'Revenue may fall after ' WHEN 2 THEN 'The root cause was ' WHEN 3 THEN 'Not a retention topic: ' WHEN 4 THEN 'Conversion fell with ' ELSE 'We saw ' END || event_type FROM events), lowered AS (SELECT *, lower(text) AS low FROM texts)",
f"""SELECT conv_id, turn, {_any(grounding.HYPOTHESIS_MARKERS)} AS hypothetical, {_any(grounding.NON_ASSERTION_MARKERS)} AS non_assertive, ({_any(grounding.BUSINESS_TERMS)}) AND NOT {_EXCUSED} AS unsupported_business,
  regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(grounding.CAUSAL_PHRASES)})($|[^\\p{{L}}\\p{{N}}_])') AND NOT {_EXCUSED} AS unsupported_causal FROM lowered""")
def _(spark, sf_dir):
    e = F.col("event_id")
    opening = (
        F.when(e % 6 == 0, "Churn is due to ").when(e % 6 == 1, "Revenue may fall after ").when(e % 6 == 2, "The root cause was ")
        .when(e % 6 == 3, "Not a retention topic: ").when(e % 6 == 4, "Conversion fell with ").otherwise("We saw ")
    )
    made = table(spark, sf_dir, "events").select(F.lit(-1).cast("long").alias("conv_id"), e.alias("turn"), F.concat(opening, "event_type").alias("text"))
    texts = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(made)
    return texts.select("conv_id", "turn", *[c.alias(n) for n, c in grounding.marker_flags(F.col("text")).items()])


CITED_CTES = FEEDBACK_CTES + """,
cited AS (SELECT country AS report_id, CASE WHEN source_row_number % 11 = 0 THEN review_id || 'x' ELSE review_id END AS review_id,
  CASE WHEN source_row_number % 7 = 0 THEN original_text || ' ' ELSE original_text END AS quote FROM feedback),
known AS (SELECT country AS report_id, review_id, original_text AS review_text FROM feedback)"""


def _cited(spark, sf_dir):
    rows = feedback(spark, sf_dir)
    n = F.col("source_row_number")
    cited = rows.select(
        F.col("country").alias("report_id"), F.when(n % 11 == 0, F.concat("review_id", F.lit("x"))).otherwise(F.col("review_id")).alias("review_id"),
        F.when(n % 7 == 0, F.concat("original_text", F.lit(" "))).otherwise(F.col("original_text")).alias("quote"),
    )
    return cited, rows.select(F.col("country").alias("report_id"), "review_id", F.col("original_text").alias("review_text"))


@query("citation_check", CITED_CTES, "SELECT DISTINCT c.report_id, c.review_id, k.review_id IS NOT NULL AS is_available FROM cited c LEFT JOIN known k ON k.report_id = c.report_id AND k.review_id = c.review_id")
def _(spark, sf_dir):
    cited, known = _cited(spark, sf_dir)
    return grounding.check_ids(cited, known)


@query("quote_check", CITED_CTES, "SELECT c.report_id, c.review_id, c.quote, CASE WHEN k.review_id IS NULL THEN 'unavailable' WHEN c.quote = k.review_text THEN 'exact' ELSE 'altered' END AS status FROM cited c LEFT JOIN known k ON k.report_id = c.report_id AND k.review_id = c.review_id")
def _(spark, sf_dir):
    return grounding.check_quotes(*_cited(spark, sf_dir))


@query("invalid_ids", CITED_CTES, "SELECT DISTINCT report_id, review_id FROM cited c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.report_id = c.report_id AND k.review_id = c.review_id)")
def _(spark, sf_dir):
    return grounding.invalid_ids(*_cited(spark, sf_dir))


@query("validated_ids", CITED_CTES, "SELECT DISTINCT report_id, review_id FROM cited c WHERE EXISTS (SELECT 1 FROM known k WHERE k.report_id = c.report_id AND k.review_id = c.review_id)")
def _(spark, sf_dir):
    return grounding.validated_ids(*_cited(spark, sf_dir))


@query("json_leaves", """""", """SELECT event_id AS report_id, 'k' AS path, 'number' AS kind, json_extract_string(props, '$.k') AS value FROM events""")
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.col("props").alias("document"))
    return grounding.json_leaves(events)


def _reports(rows):
    """One report per platform, quoting a review of it; the report of Web cites an unknown id and an unfounded share."""
    web = F.col("platform") == "Web"
    ids = F.array(F.when(web, "EV-unknown").otherwise(F.col("id")))
    limits = F.lit("Small sample.")
    problem = F.struct(
        F.lit(1).alias("rank"), F.lit("Pain").alias("title"), F.concat(F.lit("Seen in "), F.when(web, "93.7%").otherwise(F.col("n").cast("string")), F.lit(" reviews")).alias("problem_summary"),
        F.lit("Users").alias("affected_users"), F.lit("Counts").alias("measured_evidence"), F.lit("High").alias("severity"), F.lit("Monitor").alias("urgency"),
        F.lit("High").alias("confidence"), ids.alias("supporting_review_ids"), limits.alias("limitations"),
    )
    chance = F.struct(
        F.lit(1).alias("rank"), F.lit("Fix").alias("title"), F.lit("Problem").alias("user_problem"), F.lit("Demand").alias("supporting_demand"), F.lit("All").alias("affected_segments"),
        F.lit("It may help").alias("likely_product_impact_hypothesis"), F.lit("Low").alias("confidence"), ids.alias("supporting_review_ids"),
        F.lit("Test it").alias("suggested_validation_step"), limits.alias("limitations"),
    )
    action = F.struct(
        F.lit(1).alias("rank"), F.lit("Look").alias("action"), F.when(web, "Complaints are due to the update").otherwise("It is frequent").alias("rationale"), F.lit("Counts").alias("evidence_summary"),
        F.lit("Team").alias("owner"), F.lit("30 days").alias("timeframe"), F.when(web, "Certain").otherwise("High").alias("confidence"), ids.alias("supporting_review_ids"), limits.alias("limitations"),
    )
    quoted = F.struct(F.col("id").alias("review_id"), F.col("text").alias("quote"))
    return rows.select(F.col("platform").alias("report_id"), F.to_json(F.struct(
        F.lit("Feedback is mixed").alias("executive_summary"), F.array(problem).alias("customer_problems"), F.array(chance).alias("product_opportunities"),
        F.array().cast("array<string>").alias("release_risks"), F.array(action).alias("recommended_actions"), F.array(quoted).alias("evidence"),
        F.struct(F.lit("High").alias("overall_confidence"), F.array(F.lit("Counts")).alias("evidence_strengths"), F.array(limits).alias("limitations")).alias("confidence_assessment"),
    )).alias("document"))


@query("report_findings")
def _(spark, sf_dir):
    """Reports of all platforms checked against the evidence contexts of the same platforms."""
    rows = stored(spark, sf_dir).withColumn("platform", F.coalesce("platform", F.lit("no platform")))
    contexts = evidence.compact_insight_context(evidence.context_rows(rows, ["platform"], generated_at=STAMP), ["platform"])
    contexts = materialize(contexts.select(F.col("platform").alias("report_id"), F.col("context_json").alias("document")))
    leaves = grounding.list_records(grounding.json_leaves(contexts), "representative_quotes", "review_id", "review_text")
    first = leaves.filter("position = 0").select(F.col("report_id").alias("platform"), F.col("review_id").alias("id"), F.col("review_text").alias("text"))
    counts = rows.groupBy("platform").agg(F.count("*").alias("n"))
    return grounding.validate_reports(_reports(first.join(counts, "platform")), contexts)


@query("report_results", FEEDBACK_CTES + """, per AS (SELECT coalesce(platform, 'no platform') AS report_id, min(review_id) AS id, count(*) AS n,
  try_cast(regexp_extract(arg_min(original_text, review_id), 'ticket (\\d+)', 1) AS DOUBLE) AS ticket FROM feedback GROUP BY 1)""", """SELECT report_id, report_id <> 'Web' AS is_valid,
  CASE WHEN report_id = 'Web' THEN 3 ELSE 0 END AS errors,
  CASE WHEN least(abs(ticket - n), abs(ticket / 100 - n)) > greatest(0.011, n * 0.012) THEN 1 ELSE 0 END AS warnings, id AS validated, CASE WHEN report_id = 'Web' THEN 'EV-unknown' ELSE '' END AS invalid, CASE WHEN report_id = 'Web' THEN '93.7%' ELSE '' END AS unsupported FROM per""")
def _(spark, sf_dir):
    """One result per report: that of Web cites an unknown review, states a share nobody measured and names a cause.

    The number of a ticket in a quote is a warning, as nothing in the evidence supports it.
    """
    rows = feedback(spark, sf_dir).withColumn("platform", F.coalesce("platform", F.lit("no platform"))).groupBy("platform").agg(
        F.count("*").alias("n"), F.min("review_id").alias("id"), F.min_by("original_text", "review_id").alias("text")
    )
    rows = materialize(rows)
    quote = F.struct(F.col("id").alias("review_id"), F.col("text").alias("review_text"))
    shown = rows.select(F.col("platform").alias("report_id"), F.to_json(F.struct(F.array(quote).alias("representative_quotes"), F.col("n").alias("total"))).alias("document"))
    found = grounding.report_results(_reports(rows), shown)
    return found.select(
        "report_id", "is_valid", F.col("errors").cast("int"), F.col("warnings").cast("int"), F.array_join("validated_review_ids", "|").alias("validated"),
        F.array_join("invalid_review_ids", "|").alias("invalid"), F.array_join("unsupported_metrics", "|").alias("unsupported"),
    )


@query("contract_violations", FEEDBACK_CTES, """SELECT 'Web' AS report_id, 'recommended_actions[0].confidence' AS path, 'not an allowed value' AS rule FROM feedback WHERE platform = 'Web' LIMIT 1""")
def _(spark, sf_dir):
    rows = feedback(spark, sf_dir).withColumn("platform", F.coalesce("platform", F.lit("no platform"))).groupBy("platform").agg(
        F.count("*").alias("n"), F.min("review_id").alias("id"), F.min("original_text").alias("text")
    )
    return contracts.contract_violations(_reports(rows))
