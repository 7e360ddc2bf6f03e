"""The enrichment stages written as SQL, to check the Spark operators against.

Works on the distinct texts of ``feedback`` and joins the results back, with plain joins between texts and terms.
"""

from __future__ import annotations

import string

from catalog.fixture import FEEDBACK_CTES, sql_rows
from feedloom.operators import sentiment as senti
from feedloom.operators import themes as theme_ops
from feedloom.vocab import Lexicon, RequestRules, ThemeRules
from feedloom.vocab import lexicon as lex
from feedloom.vocab import requests as req


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_PUNCT = "[" + "".join("\\" + c for c in string.punctuation) + "]"
_PUNCT_SQL = _PUNCT.replace("'", "''")


def _shift(v: str, n: int) -> str:
    """One step of the modifiers: the n-th previous token boosts, then negates."""
    size = f"({lex.BOOST} + CASE WHEN up{n} AND mixed THEN {lex.CAPS_SHIFT} ELSE 0 END) * {lex.BOOST_DECAY[n - 1]}"
    boosted = (
        f"{v} + CASE WHEN lx{n} IS NOT NULL THEN 0 WHEN low{n} IN {_in(lex.INTENSIFIERS)} THEN {size} * CASE WHEN {v} >= 0 THEN 1 ELSE -1 END "
        f"WHEN low{n} IN {_in(lex.DAMPENERS)} THEN -({size}) * CASE WHEN {v} >= 0 THEN 1 ELSE -1 END ELSE 0 END"
    )
    return f"({boosted}) * CASE WHEN lx{n} IS NULL AND low{n} IN {_in(lex.NEGATIONS)} THEN {lex.NEGATION_FACTOR} ELSE 1 END"


POLARITY_CTES = f"""
texts AS (SELECT DISTINCT clean_text FROM feedback),
lexicon(token, valence) AS (SELECT * FROM {sql_rows(Lexicon.default().valences.items())} v(token, valence)),
parts AS (SELECT clean_text, string_split_regex(trim(clean_text), '\\s+') AS p FROM texts),
raws AS (SELECT clean_text, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM parts),
toks AS (
  SELECT clean_text, i, CASE WHEN s = '' THEN raw ELSE s END AS tok
  FROM (SELECT *, regexp_replace(raw, '^{_PUNCT_SQL}+|{_PUNCT_SQL}+$', '', 'g') AS s FROM raws)),
marked AS (
  SELECT t.*, lower(tok) AS low, (upper(tok) = tok AND lower(tok) <> tok) AS up, l.valence AS lx
  FROM toks t LEFT JOIN lexicon l ON l.token = lower(t.tok)),
near AS (
  SELECT *,
    sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY clean_text) > 0
      AND sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY clean_text) < count(*) OVER (PARTITION BY clean_text) AS mixed,
    min(CASE WHEN low = 'but' THEN i END) OVER (PARTITION BY clean_text) AS but_at,
    lag(low, 1) OVER w AS low1, lag(low, 2) OVER w AS low2, lag(low, 3) OVER w AS low3,
    lag(lx, 1) OVER w AS lx1, lag(lx, 2) OVER w AS lx2, lag(lx, 3) OVER w AS lx3,
    lag(up, 1) OVER w AS up1, lag(up, 2) OVER w AS up2, lag(up, 3) OVER w AS up3
  FROM marked WINDOW w AS (PARTITION BY clean_text ORDER BY i)),
v0 AS (SELECT *, lx + CASE WHEN up AND mixed THEN CASE WHEN lx > 0 THEN {lex.CAPS_SHIFT} ELSE -{lex.CAPS_SHIFT} END ELSE 0 END AS a
       FROM near WHERE lx <> 0 AND low NOT IN {_in(lex.INTENSIFIERS + lex.DAMPENERS)}),
v1 AS (SELECT *, {_shift('a', 1)} AS b FROM v0),
v2 AS (SELECT *, {_shift('b', 2)} AS c FROM v1),
v3 AS (SELECT *, {_shift('c', 3)} AS d FROM v2),
summed AS (
  SELECT clean_text, sum(d * CASE WHEN but_at IS NULL OR i = but_at THEN 1 WHEN i < but_at THEN {lex.BEFORE_BUT} ELSE {lex.AFTER_BUT} END) AS total
  FROM v3 GROUP BY clean_text),
stressed AS (
  SELECT clean_text, total, least(length(clean_text) - length(replace(clean_text, '!', '')), {lex.EXCLAIM_LIMIT}) * {lex.EXCLAIM_STEP}
    + CASE WHEN q <= 1 THEN 0 WHEN q <= 3 THEN q * {lex.QUESTION_STEP} ELSE {lex.QUESTION_CEILING} END AS emphasis
  FROM (SELECT *, length(clean_text) - length(replace(clean_text, '?', '')) AS q FROM summed)),
finals AS (SELECT clean_text, total + CASE WHEN total > 0 THEN emphasis WHEN total < 0 THEN -emphasis ELSE 0 END AS x FROM stressed),
polarity AS (
  SELECT t.clean_text, coalesce(round(x / sqrt(x * x + {lex.NORMALISER}), 4), 0.0) AS polarity
  FROM texts t LEFT JOIN finals f USING (clean_text))"""

_FAILING = " OR ".join(f"contains(low, '{w.replace(chr(39), chr(39) * 2)}')" for w in senti.FAILURE_WORDING)
SENTIMENT_CTES = f"""
keyed AS (
  SELECT f.*, lower(trim(f.clean_text)) AS low, p.polarity FROM feedback f JOIN polarity p USING (clean_text)),
worded AS (
  SELECT *, CASE WHEN low IN {_in(senti.NEGATIVE_TEXTS)} THEN -0.8 WHEN low IN {_in(senti.POSITIVE_TEXTS)} THEN 0.8
    WHEN low IN {_in(senti.NEUTRAL_TEXTS)} THEN 0.0 WHEN {_FAILING} THEN least(polarity, -0.7) END AS kw FROM keyed),
blended AS (
  SELECT *, coalesce(kw, polarity) AS ts,
    0.55 * coalesce(kw, polarity) + 0.45 * CASE CAST(round_even(rating, 0) AS INT) WHEN 1 THEN -1.0 WHEN 2 THEN -0.65 WHEN 3 THEN 0.0 WHEN 4 THEN 0.65 ELSE 1.0 END AS mix
  FROM worded),
scored AS (
  SELECT *, greatest(-1.0, least(1.0, CASE WHEN low = '' THEN 0.0 WHEN rating IS NULL THEN ts WHEN rating <= 2 THEN least(mix, -0.35)
    WHEN rating >= 4 THEN greatest(mix, 0.25) WHEN rating = 3 AND abs(ts) < 0.6 THEN 0.5 * ts ELSE mix END)) AS sentiment_score
  FROM blended),
sentiments AS (
  SELECT *, CASE WHEN sentiment_score >= 0.25 THEN 'Positive' WHEN sentiment_score <= -0.25 THEN 'Negative' ELSE 'Neutral' END AS sentiment,
    greatest(0.0, least(1.0, -sentiment_score)) AS negativity_score,
    CASE WHEN low = '' THEN 'safe_neutral' WHEN rating IS NULL THEN CASE WHEN kw IS NULL THEN 'vader' ELSE 'keyword' END
      ELSE CASE WHEN kw IS NULL THEN 'vader_rating_hybrid' ELSE 'keyword_rating_hybrid' END END AS sentiment_method
  FROM scored)"""

_REQ = RequestRules.default().rules
_req_terms, _req_combos, _req_bars = [], [], []
for _g, _rule in enumerate(_REQ):
    _n = 0
    for _p in _rule.phrases:
        _req_terms.append((_g, "phrase", _p, 6 if " " in _p else 2, _n))
        _n += 1
    for _k in _rule.keywords:
        _req_terms.append((_g, "keyword", _k, 2, _n))
        _n += 1
    for _c in _rule.combinations:
        _req_combos.append((_g, _n, " + ".join(_c), _c[0], _c[1]))
        _n += 1
    _req_bars += [(_g, _x) for _x in _rule.exclusions]


def _regex(words) -> str:
    return "\\b(?:" + "|".join(words) + ")\\b"


_rewritten = "lower(clean_text)"
for _wrong, _right in req.REWRITES:
    _rewritten = f"regexp_replace({_rewritten}, '\\b{_wrong}\\b', '{_right}', 'g')"

REQUEST_CTES = f"""
req_groups(g, grp, priority) AS (SELECT * FROM {sql_rows((i, r.group, r.priority) for i, r in enumerate(_REQ))} v(g, grp, priority)),
req_terms(g, kind, term, points, ord) AS (SELECT * FROM {sql_rows(_req_terms)} v(g, kind, term, points, ord)),
req_combos(g, ord, term, a, b) AS (SELECT * FROM {sql_rows(_req_combos)} v(g, ord, term, a, b)),
req_bars(g, term) AS (SELECT * FROM {sql_rows(_req_bars)} v(g, term)),
normal AS (
  SELECT DISTINCT clean_text, trim(regexp_replace(regexp_replace({_rewritten}, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM feedback),
req_hits AS (
  SELECT clean_text, g, term, points, ord FROM normal JOIN req_terms
    ON CASE kind WHEN 'phrase' THEN contains(n, term) ELSE list_contains(string_split(n, ' '), term) END
  UNION ALL SELECT clean_text, g, term, 3, ord FROM normal JOIN req_combos ON contains(n, a) AND contains(n, b)),
req_scores AS (
  SELECT clean_text, g, sum(points) AS score, string_agg(term, ', ' ORDER BY ord) AS terms FROM req_hits h
  WHERE NOT EXISTS (SELECT 1 FROM req_bars x JOIN normal m ON m.clean_text = h.clean_text WHERE x.g = h.g AND contains(m.n, x.term))
  GROUP BY clean_text, g),
req_best AS (
  SELECT * FROM (SELECT s.*, grp, row_number() OVER (PARTITION BY clean_text
    ORDER BY CASE WHEN grp = '{req.PREFERRED_GROUP}' AND score >= 6 THEN 0 ELSE 1 END, score DESC, priority) AS rk
    FROM req_scores s JOIN req_groups USING (g)) WHERE rk = 1),
req_kind AS (
  SELECT n.clean_text, b.grp, b.score, b.terms, CASE
    WHEN n.n = '' OR regexp_matches(n.n, '{_regex(req.COMPLAINT_PHRASES)}') THEN 'no_request_intent'
    WHEN b.score IS NOT NULL AND (regexp_matches(n.n, '{_regex(req.INTENT_PHRASES)}')
      OR regexp_matches(n.n, '^(?:{'|'.join(req.IMPERATIVE_VERBS)})\\b') OR regexp_matches(n.n, '^(?:i )?need\\b')) THEN 'taxonomy_phrase'
    WHEN b.score IS NULL AND regexp_matches(n.n, '{_regex(req.FALLBACK_PHRASES)}') THEN 'intent_fallback'
    ELSE 'no_request_intent' END AS method
  FROM normal n LEFT JOIN req_best b USING (clean_text)),
requests AS (
  SELECT clean_text, method <> 'no_request_intent' AS is_feature_request, method AS feature_request_method,
    CASE method WHEN 'taxonomy_phrase' THEN grp WHEN 'intent_fallback' THEN 'Other feature request' END AS feature_request_group,
    CASE method WHEN 'taxonomy_phrase' THEN grp WHEN 'intent_fallback' THEN 'Other requested capability' END AS feature_request_text,
    CASE method WHEN 'taxonomy_phrase' THEN CASE WHEN score >= 12 THEN 0.96 WHEN score >= 6 THEN 0.9 WHEN score >= 3 THEN 0.78 ELSE 0.68 END
      WHEN 'intent_fallback' THEN 0.58 ELSE 0.0 END AS feature_request_confidence,
    CASE WHEN method = 'taxonomy_phrase' THEN terms END AS feature_request_matched_terms,
    CASE WHEN method = 'taxonomy_phrase' THEN CAST(score AS DOUBLE) ELSE 0.0 END AS feature_request_score
  FROM req_kind)"""

_RULES = ThemeRules.default().rules
_theme_terms = [(i, t, 3, 1) for i, r in enumerate(_RULES) for t in r.phrases]
_theme_terms += [(i, t, 1, 0) for i, r in enumerate(_RULES) for t in r.keywords]
_docs = [(i, " ".join((r.theme, r.subtheme, *r.phrases, *r.keywords))) for i, r in enumerate(_RULES)]

THEME_CTES = f"""
rules(r, theme, subtheme) AS (SELECT * FROM {sql_rows((i, r.theme, r.subtheme) for i, r in enumerate(_RULES))} v(r, theme, subtheme)),
rule_terms(r, term, points, phrase) AS (SELECT * FROM {sql_rows(_theme_terms)} v(r, term, points, phrase)),
lowered AS (SELECT DISTINCT clean_text, trim(regexp_replace(lower(clean_text), '\\s+', ' ', 'g')) AS t FROM feedback),
rule_scores AS (
  SELECT clean_text, r, theme, subtheme, sum(points) AS score, max(phrase) AS phrase
  FROM lowered JOIN rule_terms ON CASE WHEN contains(term, ' ') OR contains(term, '-') THEN contains(t, term)
    ELSE list_contains(string_split_regex(t, '[^\\p{{L}}\\p{{N}}_]+'), term) END
  JOIN rules USING (r) GROUP BY clean_text, r, theme, subtheme),
rule_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clean_text ORDER BY score DESC, r) AS rk FROM rule_scores) WHERE rk = 1),
rule_second AS (
  SELECT clean_text, theme AS secondary FROM (
    SELECT s.clean_text, s.theme, row_number() OVER (PARTITION BY s.clean_text ORDER BY s.score DESC, s.r) AS rk
    FROM rule_scores s JOIN rule_top t ON s.clean_text = t.clean_text AND s.theme <> t.theme) WHERE rk = 1),
docs(r, doc) AS (SELECT * FROM {sql_rows(_docs)} v(r, doc)),
doc_parts AS (SELECT r, regexp_extract_all(lower(doc), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS p FROM docs),
doc_words AS (SELECT r, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM doc_parts),
doc_grams AS (
  SELECT r, w AS gram FROM doc_words
  UNION ALL SELECT r, w || ' ' || nxt FROM (SELECT r, w, lead(w) OVER (PARTITION BY r ORDER BY i) AS nxt FROM doc_words) WHERE nxt IS NOT NULL),
doc_tf AS (SELECT r, gram, count(*) AS n FROM doc_grams GROUP BY r, gram),
idf AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + count(*))) + 1.0 AS idf FROM doc_tf GROUP BY gram),
doc_raw AS (SELECT r, gram, (1.0 + ln(n)) * idf AS w FROM doc_tf JOIN idf USING (gram)),
doc_norm AS (SELECT r, sqrt(sum(w * w)) AS norm FROM doc_raw GROUP BY r),
unmatched AS (SELECT clean_text, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS p FROM lowered WHERE clean_text NOT IN (SELECT clean_text FROM rule_top)),
q_words AS (SELECT clean_text, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM unmatched),
q_grams AS (
  SELECT clean_text, w AS gram FROM q_words
  UNION ALL SELECT clean_text, w || ' ' || nxt FROM (SELECT clean_text, w, lead(w) OVER (PARTITION BY clean_text ORDER BY i) AS nxt FROM q_words) WHERE nxt IS NOT NULL),
q_raw AS (SELECT clean_text, gram, (1.0 + ln(count(*))) * any_value(idf) AS w FROM q_grams JOIN idf USING (gram) GROUP BY clean_text, gram),
q_norm AS (SELECT clean_text, sqrt(sum(w * w)) AS norm FROM q_raw GROUP BY clean_text),
sims AS (
  SELECT q.clean_text, d.r, sum(q.w / qn.norm * d.w / dn.norm) AS sim
  FROM q_raw q JOIN q_norm qn USING (clean_text) JOIN doc_raw d USING (gram) JOIN doc_norm dn ON dn.r = d.r GROUP BY q.clean_text, d.r),
closest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clean_text ORDER BY round(sim, 12) DESC, r) AS rk FROM sims) WHERE rk = 1),
analyzed AS (
  SELECT s.* EXCLUDE (low, polarity, kw, ts, mix), q.* EXCLUDE (clean_text), q.is_feature_request AS feature_request_detected,
    CASE WHEN q.is_feature_request THEN 'Feature Request' WHEN t.theme IS NOT NULL THEN t.theme
      WHEN c.sim >= {theme_ops.SIMILARITY_AT} THEN cr.theme WHEN s.sentiment = 'Positive' AND s.low <> '' THEN 'Positive Feedback' ELSE 'Other' END AS primary_theme,
    CASE WHEN NOT q.is_feature_request AND t.theme IS NOT NULL THEN x.secondary END AS secondary_theme,
    CASE WHEN q.is_feature_request THEN q.feature_request_group WHEN t.theme IS NOT NULL THEN t.subtheme
      WHEN c.sim >= 0.16 THEN cr.subtheme WHEN s.sentiment = 'Positive' AND s.low <> '' THEN 'General praise' ELSE 'Ambiguous' END AS subtheme,
    CAST(CASE WHEN q.is_feature_request THEN greatest(0.8, q.feature_request_confidence) WHEN s.low = '' THEN 0.1
      WHEN t.theme IS NOT NULL THEN least(0.98, 0.62 + 0.09 * t.score) WHEN c.sim >= 0.16 THEN least(0.7, 0.35 + c.sim)
      WHEN s.sentiment = 'Positive' THEN 0.55 ELSE 0.2 END AS DOUBLE) AS classification_confidence,
    CASE WHEN q.is_feature_request THEN 'rule_exact_phrase' WHEN s.low = '' THEN 'fallback_other'
      WHEN t.theme IS NOT NULL THEN CASE WHEN t.phrase = 1 THEN 'rule_exact_phrase' ELSE 'rule_keyword' END
      WHEN c.sim >= 0.16 THEN 'tfidf_similarity' WHEN s.sentiment = 'Positive' THEN 'fallback_positive' ELSE 'fallback_other' END AS classification_method
  FROM sentiments s JOIN requests q USING (clean_text) LEFT JOIN rule_top t USING (clean_text) LEFT JOIN rule_second x USING (clean_text)
    LEFT JOIN closest c USING (clean_text) LEFT JOIN rules cr ON cr.r = c.r)"""

ANALYZED_CTES = ",".join((FEEDBACK_CTES, POLARITY_CTES, SENTIMENT_CTES, REQUEST_CTES, THEME_CTES))
