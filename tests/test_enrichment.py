"""Sentiment, request and theme behaviour."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from feedloom.functions.search import _finder, _regex_finder
from feedloom.functions.text import WORD, WS, collapse_ws, nfkc, request_text
from feedloom.operators import rule_tables
from feedloom.operators.grouping import computed_once
from feedloom.operators.requests import add_feature_request_columns
from feedloom.operators.sentiment import add_polarity_signal, add_sentiment_columns, polarity, polarity_in_plan, score_text
from feedloom.operators.signals import enrich
from feedloom.operators.rule_tables import _beside, _entries, _entry, match_rule_table, rule_terms, term_matches
from feedloom.operators.themes import add_classification_columns, add_theme_signals, match_rules
from feedloom.vocab import Lexicon, RequestRules, ThemeRules
from feedloom.vocab import lexicon as shifts
from feedloom.vocab.requests import REWRITES

# Own sentences, one per branch.
SENTIMENTS = [
    ("great crust and a good sauce", None, "Positive"), ("a bad and terrible new menu", None, "Negative"), ("arrived on tuesday", None, "Neutral"),
    ("The pasta was great although the payment failed", 1.0, "Negative"), ("Love the new icons", 5.0, "Positive"),
    ("the map is not working since noon", None, "Negative"), ("", None, "Neutral"), (None, None, "Neutral"), ("A terrible ride home", None, "Negative"),
    ("plain box, plain lid", 1.5, "Negative"), ("plain box, plain lid", 2.5, "Negative"), ("plain box, plain lid", 3.5, "Positive"), ("plain box, plain lid", 9.0, "Neutral"),
]
THEMES = [
    ("At the till my payment failed and the money deducted stayed away", "Payment and Checkout"), ("A late delivery for the third sunday running", "Delivery Experience"),
    ("Six weeks on and still refund not received", "Refunds and Cancellations"), ("Whenever it rains the app crashes", "App Performance"),
    ("Standing at the door, otp not received", "Login and Account"), ("Two spoons and one item was missing", "Missing or Incorrect Items"),
    ("Wonderful folks, excellent service all round", "Positive Feedback"), ("zzz", "Other"),
    ("A plate order of two", "Delivery Experience"),
]
REQUESTS = [
    ("Please add an export as pdf for my accountant", "Data Export and Reports"), ("I wish there was an expense planner", "Budgeting and Spending Insights"),
    ("Could you add a repeat transfer for the rent", "Scheduled and Recurring Payments"), ("It would help to have a night colour scheme", "Dark Mode and Appearance"),
    ("Please support foreign currencies", "Multi-Currency and International Support"), ("Allow me to lock my card", "Card Controls"),
    ("There should be a way to sort by name", "Search, Filters, and Sorting"), ("Please provide a balance widget", "Widgets and Quick Access"),
    ("We need an option for a household wallet", "Family and Shared Accounts"), ("It should support staff roles", "Team and Business Access"),
    ("Enable calendar sync", "API and Integrations"), ("Can you add bill reminders", "Notifications and Custom Alerts"),
    ("Support fingerprint login", "Security and Biometric Controls"), ("Let me manage recipients", "Bank and Account Management"),
    ("Please introduce custom labels", "Personalization"), ("Show yearly statements", "Statements and Transaction History"),
    ("Please add bonus tiers", "Rewards and Loyalty"), ("We would love a human agent", "Customer Support Improvements"),
    ("Please support google pay", "Payment Methods and Wallets"), ("Download yearly statements as pdf", "Data Export and Reports"),
    # Several groups in one text: the order of groups, their points, bars and the preferred group decide.
    ("Give us an option: accounting integration and a ledger export", "Data Export and Reports"), ("Allow staff to export the reconciliation of the month", "Data Export and Reports"),
    ("Add dark mode with larger text and a widget", "Dark Mode and Appearance"), ("Need a wallet integration", "Payment Methods and Wallets"), ("Need an EUR wallet", "Multi-Currency and International Support"),
    ("Add my own spending categories", "Budgeting and Spending Insights"), ("Need Face-ID, the code by text never comes", "Security and Biometric Controls"), ("pls add darkmode", "Dark Mode and Appearance"),
    ("Need auto-pay for the rent", "Scheduled and Recurring Payments"), ("I want a custom home screen", "Personalization"), ("Add a smartwatch face", "Widgets and Quick Access"),
    ("Please add purple balloons", "Other feature request"),
]
COMPLAINTS = ["The transfer is stuck since noon", "I need my refund before the weekend", "My statement is wrong by two euros", "The agent was rude again", "Support should respond faster", "The app needs to stop crashing and please add nothing", "I want my money back, export or not"]


def test_sentiment(spark):
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(SENTIMENTS)], "i int, clean_text string, rating double")
    rows = add_sentiment_columns(df).orderBy("i").collect()
    assert [r["sentiment"] for r in rows] == [s for *_, s in SENTIMENTS]
    assert all(-1 <= r["sentiment_score"] <= 1 and 0 <= r["negativity_score"] <= 1 for r in rows)
    assert rows[6]["sentiment_method"] == "safe_neutral" and rows[12]["sentiment_method"] == "vader"


def polarities(spark, texts, lexicon=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(
        "i", polarity(F.col("text"), lexicon).alias("workers"), polarity_in_plan(F.col("text"), lexicon).alias("plan")).collect()
    assert [r for r in rows if r["workers"] is None or r["plan"] is None] == [r for r in rows if r["workers"] is None and r["plan"] is None]
    return [r["plan"] for r in sorted(rows, key=lambda r: r["i"])]


def test_polarity_modifiers(spark):
    texts = ["good", "not good", "very good", "it is GOOD", "it is good", "good!!!", "good but bad", "table", "", None, "!!! ??", "(good), not... \u2003bad??"]
    good, negated, strong, loud, calm, stressed, turned, *rest = polarities(spark, texts)
    assert good == round(1.9 / (1.9**2 + 15) ** 0.5, 4)
    assert negated < 0 < good < strong and loud > calm and stressed > good and turned < 0
    assert rest[:4] == [0.0, 0.0, None, 0.0] and rest[4] == score_text(texts[-1], Lexicon.default().valences)


def test_polarity_equals_plain_reader(spark):
    dealer = random.Random(5)
    words = [*list(Lexicon.default().valences)[:30], *shifts.INTENSIFIERS, *shifts.DAMPENERS, *shifts.NEGATIONS, "but", "but", "the", "I", "--", "Straße", "ÉTÉ", "плохо", "so-so"]
    ends = ["", "", "", "!", "!!", "?", "??", "...", "\"", ")", "'"]

    def text():
        picked = [dealer.choice(words) for _ in range(dealer.randrange(0, 14))]
        picked = [w.upper() if dealer.random() < 0.2 else w.capitalize() if dealer.random() < 0.2 else w for w in picked]
        return dealer.choice([" ", "  ", "\t", "\u00a0"]).join(dealer.choice(["", "", "(", "'"]) + w + dealer.choice(ends) for w in picked)

    texts = [text() for _ in range(3000)] + ["very " * 5000 + "good", "!" * 20_000, "good " * 3000]
    # A lexicon that knows strengthening and turning words, words of value zero and words of other scripts.
    rows = [("very", 1.5), ("not", -0.5), ("table", 0.0), ("плохо", -2.0), ("été", 1.0), *[(f"w{i}", (i % 9) - 4.0) for i in range(9000)], *Lexicon.default().valences.items(), ("good", -3.0)]
    large = Lexicon.from_dataframe(spark.createDataFrame(rows, "token string, valence double"))
    assert large.valences["good"] == 1.9
    for lexicon in (Lexicon.default(), large, Lexicon({})):
        found = polarities(spark, texts, lexicon)
        assert [t for t, p in zip(texts, found, strict=True) if abs(p - score_text(t, lexicon.valences)) > 1.01e-4] == []
        assert sum(p != score_text(t, lexicon.valences) for t, p in zip(texts, found, strict=True)) <= 2


def test_polarity_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("a good ride", 4.0)], "clean_text string, rating double")
    for frame in (add_polarity_signal(df, in_plan=True), add_sentiment_columns(df, in_plan=True)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan and "from_json" not in plan


def test_requests(spark):
    texts = [t for t, _ in REQUESTS] + COMPLAINTS + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, clean_text string")
    rows = add_feature_request_columns(df).orderBy("i").collect()
    for (text, group), r in zip(REQUESTS, rows, strict=False):
        assert r["is_feature_request"] and r["feature_request_group"] == group, text
    assert not any(r["is_feature_request"] for r in rows[len(REQUESTS):])
    assert rows[len(REQUESTS) - 1]["feature_request_method"] == "intent_fallback"
    assert rows[0]["feature_request_confidence"] == 0.78 and rows[0]["feature_request_matched_terms"] == "export, pdf"
    assert rows[7 - 4]["feature_request_confidence"] == 0.9 and rows[20 - 1]["feature_request_matched_terms"] == "pdf, download, download + statement"


def test_themes(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(THEMES)], "i int, clean_text string")
    rows = add_classification_columns(df).orderBy("i").collect()
    assert [r["primary_theme"] for r in rows] == [t for _, t in THEMES]
    two = spark.createDataFrame([("at the till the payment failed and my money deducted, then a late delivery",)], "clean_text string")
    row = add_classification_columns(two).first()
    assert row["primary_theme"] == "Payment and Checkout" and row["secondary_theme"] == "Delivery Experience"
    assert row["classification_confidence"] == pytest.approx(0.98)


def test_enrichment_does_not_depend_on_layout_or_stage_order(spark, feedback):
    columns = ["review_id", "sentiment", "primary_theme", "feature_request_group", "classification_confidence"]
    one = {tuple(r) for r in enrich(feedback.coalesce(1)).select(columns).collect()}
    many = {tuple(r) for r in enrich(feedback.repartition(5)).select(columns).collect()}
    by_hand = add_classification_columns(add_feature_request_columns(add_sentiment_columns(feedback)))
    assert one == many == {tuple(r) for r in by_hand.select(columns).collect()}


def test_finders_agree():
    terms = ("card", "card limit", "a", "imit s", "limit")
    text = "set a card limit soon, no cardlimits"
    assert sorted(_finder(terms)(text)) == sorted(_regex_finder(terms)(text))


def test_rule_tables_load_and_check(spark):
    themes = spark.createDataFrame([(1, "B", "b", ["two words"], ["two"]), (0, "A", "a", [], ["one"])],
                                   "rule_idx int, theme string, subtheme string, phrases array<string>, keywords array<string>")
    rules = ThemeRules.from_dataframe(themes)
    assert [r.theme for r in rules.rules] == ["A", "B"]
    df = spark.createDataFrame([("c++ and one",), ("twofold two words",)], "clean_text string")
    odd = ThemeRules.from_rows([("C", "c", [], ["c++"]), *[(r.theme, r.subtheme, r.phrases, r.keywords) for r in rules.rules]])
    assert [r["primary_theme"] for r in add_classification_columns(df, odd).collect()] == ["A", "B"]
    with pytest.raises(ValueError, match="priority"):
        RequestRules.from_rows([("g", 1, ["a"], [], [], []), ("h", 1, ["b"], [], [], [])])


def test_enrichment_is_map_only_and_searches_once_per_stage(feedback):
    plan = enrich(feedback.select("review_id", "clean_text", "rating"), normalise=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") <= 4
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rule_tables_match_like_rules_in_the_plan(spark, feedback):
    """The same rules as a table and inside the plan give the same match for every text; so do terms that share all runs."""
    rows = [("A", "a", ["ab ab ab", "x-y"], ["on"]), ("B", "b", ["ab ab", "late order"], ["one", "é"]), ("C", "c", ["b a"], ["ab", "on", "ab"]), ("A", "z", [], ["late"])]
    texts = ["ab ab ab", "b ab abx", "plate orders, on one", "it is on", "É ab", "x-yz", "", None, "  ", "nothing here", "late", "On-one;late order"]
    tables = {
        "odd": (spark.createDataFrame(list(enumerate(texts)), "i long, clean_text string"), rows),
        "all": (feedback.select(F.col("source_row_number").alias("i"), "clean_text"), [(r.theme, r.subtheme, r.phrases, r.keywords) for r in ThemeRules.default().rules]),
    }
    for df, rules in tables.values():
        inside = match_rules(add_theme_signals(df, ThemeRules.from_rows(rules)), ThemeRules.from_rows(rules)).where("_match IS NOT NULL")
        frame = spark.createDataFrame([(i, t, s, list(p), list(k)) for i, (t, s, p, k) in enumerate(rules)], "rule_idx int, theme string, subtheme string, phrases array<string>, keywords array<string>")
        got = {r["i"]: (r["theme"], r["subtheme"], r["score"], r["by_phrase"], r["secondary"]) for r in match_rule_table(df, frame, "i").collect()}
        assert got == {r["i"]: tuple(r["_match"][n] for n in ("theme", "subtheme", "score", "by_phrase", "secondary")) for r in inside.collect()} and got
    assert match_rule_table(tables["odd"][0], frame.limit(0), "i").collect() == []


def test_terms_that_occur_are_found_whatever_their_runs(spark):
    """Against plain Python over texts and terms of few letters, where every run is shared."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab -") for _ in range(rng.randint(1, 25))) for _ in range(150)]
    terms = sorted({t for t in ("".join(rng.choice("ab -") for _ in range(rng.randint(1, 6))).strip() for _ in range(120)) if t and (len(t) > 2 or not re.search("[ -]", t))})
    frame = spark.createDataFrame([(i, [t], []) for i, t in enumerate(terms)], "rule_idx int, phrases array<string>, keywords array<string>")
    found = {(r["i"], terms[r["rule_idx"]]) for r in term_matches(spark.createDataFrame(list(enumerate(texts)), "i long, clean_text string"), rule_terms(frame), "i").collect()}
    def occurs(term, text):
        text = " ".join(text.split())
        return term in text if re.search("[ -]", term) else term in re.split("[^ab]+", text)
    assert found == {(i, t) for i, text in enumerate(texts) for t in terms if occurs(t, text)}


def test_rule_table_probes_follow_the_texts(spark):
    """Many terms that share all their runs of characters with the numbers of a text give no candidates, and none is lost."""
    n = 300
    rules = spark.range(n).selectExpr("cast(id AS int) AS rule_idx", "'Part' AS theme", "cast(id AS string) AS subtheme", "array(concat('lot 1', id, '1 of two')) AS phrases", "array(concat('p1', id, '111')) AS keywords")
    texts = spark.createDataFrame([(i, f"(ticket 1111{i}1111 of p1) lot 1 of {'p17111' if i == 7 else 'none'}") for i in range(40)] + [(99, "the lot 151 of two")], "i long, clean_text string")
    terms = rule_terms(rules)
    found = term_matches(texts, terms, "i")
    assert sorted((r["i"], r["needle"]) for r in found.collect()) == [(7, "p17111"), (99, "lot 151 of two")]
    # Candidates are no more than the texts, however many terms there are.
    entries = _entries(terms.where("by_phrase = 1").select("needle").distinct())
    kept = _beside(texts, "clean_text", "i").select("i", _entry((3, 3)).alias("_print")).join(entries, "_print")
    assert kept.count() <= 41


def test_signals_share_one_python_worker(feedback):
    """All searches and the polarity are one evaluation, the normal form of the view another: a task holds two workers."""
    plan = enrich(feedback, normalise=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 2


def test_looks_ahead_of_patterns_change_no_text(spark):
    """Against the patterns without a look, over words that are rewritten, blanks of all kinds, dashes and wide letters."""
    rng = random.Random(11)
    words = ["autopay", "auto–pay", "auto-pay", "auto pay", "AUTO PAY", "xdarkmode", "darkmode", "faceid's", "pls", "plsx", "multicurrency", "é", "ﬁne", "’", "—", "?!", "_", "9", "İ", "a"]
    blanks = [" ", "  ", "\t", " ", "　", "\x1f", "\n", "-", ""]
    texts = ["".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = F.translate(F.lower("t"), "’–—", "'--")
    for wrong, right in REWRITES:
        plain = F.regexp_replace(plain, f"(?<![{WORD}])(?:{wrong.replace(chr(92) + 's', WS)})(?![{WORD}])", right)
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, f"[^{WORD}{WS}]", " "), f"[{WS}]+", " "))
    changed = df.where(~request_text(F.col("t"), False).eqNullSafe(plain) | ~collapse_ws(F.col("t")).eqNullSafe(F.trim(F.regexp_replace("t", f"[{WS}]+", " "))))
    assert changed.count() == 0
    assert [r[0] for r in df.select(nfkc(F.col("t"))).collect()] == [*(unicodedata.normalize("NFKC", t) for t in texts), None]


def test_outputs_are_projected_before_they_are_spread(spark):
    """A generator would interpret what it holds, so it only holds the finished struct."""
    df = spark.range(3).select("id", (F.col("id") * 2).alias("twice"))
    out = computed_once(df, ["id"], [F.when(F.col("twice") > 2, F.col("twice")).alias("a"), (F.col("twice") + 1).alias("b")])
    generators = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in line]
    assert len(generators) == 1 and "CASE" not in generators[0]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(0, None, 1), (1, None, 3), (2, 4, 5)]


def test_small_rule_tables_are_met_without_python_workers(spark, monkeypatch):
    """Few terms go to all tasks, so no filter goes ahead of the joins; with many, it gives the same matches."""
    rules = spark.createDataFrame([(0, ["late order"], ["late"]), (1, ["x-y"], ["order"])], "rule_idx int, phrases array<string>, keywords array<string>")
    texts = spark.createDataFrame([(0, "plate orders"), (1, "a late order"), (2, "x-yz order"), (3, "none")], "i long, clean_text string")
    found = []
    for bound in (100_000, 0):
        monkeypatch.setattr(rule_tables, "SMALL", bound)
        matches = term_matches(texts, rule_terms(rules), "i")
        assert ("ArrowEvalPython" in matches._jdf.queryExecution().executedPlan().toString()) == (bound == 0)
        found.append(sorted((r["i"], r["needle"]) for r in matches.collect()))
    assert found[0] == found[1] == [(0, "late order"), (1, "late"), (1, "late order"), (1, "order"), (2, "order"), (2, "x-y")]
