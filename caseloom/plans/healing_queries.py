"""Queries on answers against explanations: denials, drift, evidence on keys and its application.

Here a case's prompt is the first sentence of its text, its options are the
first four, and its explanation is all after them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, healing
from . import views
from .queries import BOTH, NORM, query

#: Common words of the four languages, and names with the ways to say them.
LISTS = {"en": ["the", "of", "in", "that", "with"], "de": ["die", "der", "und", "das", "ist"], "fr": ["le", "les", "dans", "que", "pour"], "es": ["el", "los", "con", "para", "una"]}
NAMES = {"first person": ["the", "die", "les", "los"], "second person": ["and the", "und die", "de la"], "third thing": ["und", "et", "que"]}
STOP = ["that", "with", "this", "dans", "para", "pour"]


def apart(s, d) -> DataFrame:
    """Cases whose explanation begins behind their options."""
    c = views.cases_with_options(s, d)
    first = F.length(F.substring_index("question", ".", 4))
    return c.withColumn("rationale", F.substr("question", first + 2, F.length("question"))).withColumn("prompt", F.col("title"))


def option_text(slot) -> F.Column:
    return F.get(F.filter("options", lambda o: o["id"] == F.substring(F.lit("ABCD"), slot.cast("int"), F.lit(1))), F.lit(0))["text"]


APART = f"""apart_v AS (SELECT * EXCLUDE (rationale), title AS prompt, array_to_string(string_split(question, '.')[5:], '.') AS rationale FROM cases_v),
  opt_v AS (SELECT case_id, option_id, slot, option_text, is_correct, {NORM.format('option_text')} AS n FROM options_v)"""
SHORT = (*BOTH, APART)


def denying(s, d) -> DataFrame:
    """Explanations that end in a denial of the answer's first long word, at a distance of up to 24 characters, behind or before it, or across a line."""
    i = F.col("case_id")
    word = F.get(F.filter(F.split(F.regexp_replace(F.lower(option_text(i % 4 + 1)), "[^a-z0-9 ]", " "), " "), lambda w: F.length(w) >= 5), F.lit(0))
    gap = F.concat(F.lit(" "), F.repeat(F.lit("x"), (i % 23).cast("int")), F.lit(" "))
    said = F.when(i % 3 == 0, F.concat(F.lit(" "), word, gap, F.lit("is wrong"))).when(i % 3 == 1, F.concat(F.lit(" Not the correct"), gap, word, F.lit("!")))
    line = F.when(i % 5 == 0, F.replace(said, F.lit(" is"), F.lit("\nis"))).otherwise(said)
    return apart(s, d).withColumn("rationale", F.concat("rationale", F.coalesce(line, F.lit(""))))


_AFTER, _BEFORE = "(?:is incorrect|is wrong|is not correct|is false|is ruled out)", "(?:incorrect answer is|wrong answer is|not the correct)"
DENY = rf"""word_v AS (SELECT a.case_id, rationale, min_by(option_text, slot) FILTER (is_correct) AS answer, count(o.case_id) AS n, count(DISTINCT lower(option_text)) AS nd, coalesce(max(length(option_text)), 0) AS longest
    FROM apart_v a LEFT JOIN opt_v o ON o.case_id = a.case_id GROUP BY a.case_id, rationale),
  near_v AS (SELECT case_id, answer, n, nd, longest, kw, rationale || coalesce(CASE WHEN case_id % 5 = 0 THEN replace(said, ' is', chr(10) || 'is') ELSE said END, '') AS r FROM (
    SELECT *, CASE case_id % 3 WHEN 0 THEN ' ' || kw || gap || 'is wrong' WHEN 1 THEN ' Not the correct' || gap || kw || '!' END AS said FROM (
      SELECT *, list_filter(string_split(regexp_replace(lower(answer), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: length(w) >= 5)[1] AS kw, ' ' || repeat('x', case_id % 23) || ' ' AS gap FROM word_v)))"""


@query("QA02_answers", rf"""SELECT case_id, 'B' AS layer, 'short_answer' AS code, 'medium' AS severity FROM near_v WHERE length(answer) < 2
  UNION ALL SELECT case_id, 'B', 'identical_options', 'critical' FROM near_v WHERE nd = 1 AND n > 1
  UNION ALL SELECT case_id, 'B', 'denied_answer', 'critical' FROM near_v WHERE length(r) > 30 AND regexp_matches(lower(r), '\b' || kw || '\b[^\n]{{0,15}}\b{_AFTER}\b|{_BEFORE}[^\n]{{0,15}}\b' || kw || '\b')
  UNION ALL SELECT case_id, 'B', 'long_option', 'low' FROM near_v WHERE longest > 500""", (*SHORT, DENY))
def _(s, d):
    return audit.audit_answers(denying(s, d))


def _hits(text: str, words: list[str]) -> str:
    said = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(string_split({text}, ' '), lambda w: w IN ({said})))"


def _language(text: str) -> str:
    n = {k: _hits(text, ws) for k, ws in LISTS.items()}
    return "CASE " + " ".join(f"WHEN {n[k]} >= 2 AND {n[k]} * 2 > greatest({', '.join(n[m] for m in n if m != k)}) * 3 THEN '{k}'" for k in n) + " ELSE 'other' END"


_LONG = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) >= 6))"
DRIFT = f"""drift_v AS (SELECT case_id FROM (SELECT case_id, {_LONG.format('a')} AS a, {_LONG.format('r')} AS r, {_LONG.format("coalesce(array_to_string(o, ' '), '')")} AS o FROM (
    SELECT a.case_id, any_value({NORM.format('rationale')}) AS r, any_value({NORM.format('prompt')}) AS p, {NORM.format("any_value(prompt) || ' ' || coalesce(min_by(option_text, slot) FILTER (is_correct), '')")} AS a, coalesce(list(n ORDER BY slot) FILTER (n <> ''), []) AS o
    FROM apart_v a LEFT JOIN opt_v o ON o.case_id = a.case_id WHERE length(rationale) >= 120 GROUP BY a.case_id)
    WHERE ({_language('p')} = {_language('r')} OR {_language('p')} = 'other' OR {_language('r')} = 'other') AND len(list_filter(o, lambda t: contains(' ' || r || ' ', ' ' || t || ' '))) = 0)
  WHERE len(a) >= 2 AND len(r) >= 4 AND len(list_intersect(a, r)) = 0 AND len(list_intersect(o, r)) = 0)"""


@query("QA10_topic_drift", "SELECT case_id FROM drift_v", (*SHORT, DRIFT))
def _(s, d):
    return audit.topic_drift(apart(s, d), LISTS, prompt="prompt")


def stated(s, d) -> DataFrame:
    """Even cases' explanations begin with a statement of one of the options, by letter and text."""
    i = F.col("case_id")
    letter = F.substring(F.lit("ABCD"), (i % 3 + 1).cast("int"), F.lit(1))
    lead = F.concat(F.lit("The correct answer is "), letter, F.lit(": "), option_text(i % 3 + 1), F.lit(". "))
    return apart(s, d).withColumn("rationale", F.concat(F.coalesce(F.when(i % 2 == 0, lead), F.lit("")), F.col("rationale")))


def raw_answers(s, d) -> DataFrame:
    """Raw answers by the options' texts: of one case in five the option behind its key, of one in fifteen another one too."""
    i = F.col("case_id")
    c = apart(s, d).withColumn("fp", healing.option_fingerprint(F.col("options")))
    one = c.where(i % 5 == 0).select("fp", option_text((i + 1) % 4 + 1).alias("answer"))
    return one.unionByName(c.where(i % 15 == 0).select("fp", option_text((i + 2) % 4 + 1).alias("answer")))


EVIDENCE = rf"""stated_v AS (SELECT a.case_id, coalesce(CASE WHEN a.case_id % 2 = 0 THEN 'The correct answer is ' || option_id || ': ' || option_text || '. ' END, '') || rationale AS r, a.case_id % 2 = 0 AND option_id IS NOT NULL AS says
    FROM apart_v a LEFT JOIN opt_v o ON o.case_id = a.case_id AND slot = 1 + a.case_id % 3),
  window_v AS (SELECT case_id, w, {NORM.format("regexp_extract(w, '^[^\\n;]*')")} AS said FROM (SELECT case_id, substring(r, 25, 120) AS w FROM stated_v WHERE says)),
  named_v AS (SELECT o.case_id, arg_min(option_id, row(instr(said, n), -length(n), slot)) AS named FROM window_v JOIN opt_v o USING (case_id)
    WHERE instr(said, n) > 0 AND length(n) >= 3 AND NOT regexp_matches(substring(w, 1, 12), '(?i)^\s*(?:>|<|/|&|,|and\b|or\b)') GROUP BY o.case_id),
  fp_v AS (SELECT case_id, coalesce(string_agg(n, '|' ORDER BY n) FILTER (n <> ''), '') AS fp, count(*) AS n_options, min_by(option_id, slot) FILTER (is_correct) AS key, min_by(n, slot) FILTER (is_correct) AS key_text FROM opt_v GROUP BY case_id),
  raw_v AS (SELECT fp, n AS a FROM fp_v JOIN opt_v o USING (case_id) WHERE case_id % 5 = 0 AND slot = 1 + (case_id + 1) % 4 UNION ALL SELECT fp, n FROM fp_v JOIN opt_v o USING (case_id) WHERE case_id % 15 = 0 AND slot = 1 + (case_id + 2) % 4),
  anchor_v AS (SELECT fp, min(a) AS anchor FROM raw_v WHERE a <> '' AND fp <> '' GROUP BY fp HAVING min(a) = max(a)),
  fit_v AS (SELECT case_id, anchor, min_by(option_id, slot) FILTER (n = anchor) AS fitting FROM fp_v JOIN anchor_v USING (fp) JOIN opt_v o USING (case_id) GROUP BY case_id, anchor),
  evidence_v AS (SELECT f.case_id, key, CASE WHEN t.n <> key_text THEN 'stated' WHEN anchor <> key_text THEN 'anchor' WHEN d.case_id IS NOT NULL THEN 'drift' END AS method, CASE WHEN t.n <> key_text THEN 'high' WHEN anchor <> key_text THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN t.n <> key_text THEN named WHEN anchor <> key_text THEN fitting END AS target FROM fp_v f LEFT JOIN named_v v ON v.case_id = f.case_id LEFT JOIN opt_v t ON t.case_id = f.case_id AND t.option_id = v.named LEFT JOIN fit_v x ON x.case_id = f.case_id LEFT JOIN drift_v d ON d.case_id = f.case_id
    WHERE n_options >= 2 AND key IS NOT NULL AND (t.n <> key_text OR anchor <> key_text OR d.case_id IS NOT NULL))"""
KEYED = (*SHORT, DRIFT, EVIDENCE)


def parts(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return stated(s, d), healing.raw_anchors(raw_answers(s, d)), audit.topic_drift(apart(s, d), LISTS, prompt="prompt")


@query("QA06_key_evidence", "SELECT case_id, key, method, confidence, target FROM evidence_v", KEYED)
def _(s, d):
    return healing.key_evidence(*parts(s, d))


@query("QA11_remediation", """SELECT case_id, 'flip' AS action, key || '>' || target AS detail FROM evidence_v WHERE confidence = 'high' UNION ALL
  SELECT case_id, CASE WHEN confidence = 'medium' THEN 'A5_CONFLICT' ELSE 'A6_DRIFT' END, method FROM evidence_v WHERE confidence <> 'high'
  UNION ALL SELECT e.case_id, 'A5_CONFLICT', 'anchor' FROM evidence_v e JOIN fit_v x ON x.case_id = e.case_id JOIN opt_v t ON t.case_id = e.case_id AND t.option_id = e.target WHERE confidence = 'high' AND anchor <> t.n
  UNION ALL SELECT e.case_id, 'A6_DRIFT', 'drift' FROM evidence_v e JOIN drift_v d ON d.case_id = e.case_id LEFT JOIN fit_v x ON x.case_id = e.case_id JOIN opt_v t ON t.case_id = e.case_id AND t.option_id = e.target WHERE confidence = 'high' AND (anchor IS NULL OR anchor = t.n)""", KEYED)
def _(s, d):
    """Flips of all rounds, and what is held afterwards: a case whose key has been flipped can still disagree with its raw source."""
    _, log, hold = healing.remediate_keys(*parts(s, d))
    flips = log.select("case_id", F.lit("flip").alias("action"), F.concat_ws(">", "key", "target").alias("detail"))
    return flips.unionByName(hold.select("case_id", F.col("code").alias("action"), F.col("method").alias("detail")))


@query("QA12_heal_from_raw", """SELECT f.case_id, key, coalesce(named, fitting) AS target, CASE WHEN named <> fitting THEN 'explicit_override' ELSE 'raw_anchor' END AS action
  FROM fp_v f JOIN fit_v x ON x.case_id = f.case_id LEFT JOIN named_v v ON v.case_id = f.case_id WHERE key IS NOT NULL AND fitting IS NOT NULL""", KEYED)
def _(s, d):
    cases, anchors, _ = parts(s, d)
    return healing.heal_from_raw(cases, anchors)


def _names(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(' ' || {text} || ' ', ' ({'|'.join(ws)}) ') THEN '{n}' END" for n, ws in NAMES.items()) + "], lambda x: x IS NOT NULL)"


_STOPS = ", ".join(f"'{w}'" for w in STOP)


def _stems(text: str, names: str) -> str:
    single = f"list_transform(string_split({text}, ' '), lambda w: CASE WHEN ends_with(w, 'ies') AND length(w) > 6 THEN substring(w, 1, length(w) - 3) || 'y' WHEN ends_with(w, 's') AND length(w) > 6 THEN substring(w, 1, length(w) - 1) ELSE w END)"
    return f"list_distinct(list_transform(list_filter(list_concat({single}, flatten(list_transform({names}, lambda x: string_split(x, ' ')))), lambda w: length(w) >= 4 AND w NOT IN ({_STOPS})), lambda w: substring(w, 1, 3)))"


_GENERIC = ", ".join(f"'{g}'" for g in healing.GENERIC)
_LOOSE = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'), ' ')"
_CUE = healing.STATEMENT.replace("'", "''")
CLEAR = rf"""stem_v AS (SELECT case_id, rationale, answer, an, pn, rn, {_stems('p', 'pn')} AS x, {_stems('r', 'rn')} AS y FROM (SELECT *, {_names('p')} AS pn, {_names('r')} AS rn FROM (
    SELECT a.case_id, any_value(rationale) AS rationale, {NORM.format('any_value(prompt)')} AS p, {NORM.format('any_value(rationale)')} AS r, min_by(option_text, slot) FILTER (is_correct) AS answer, min_by(n, slot) FILTER (is_correct) AS an
    FROM apart_v a LEFT JOIN opt_v o ON o.case_id = a.case_id GROUP BY a.case_id))),
  clear_v AS (SELECT case_id, len(x) AS prefixes, len(list_intersect(x, y)) AS shared, len(list_intersect(pn, rn)) > 0 AS same, regexp_matches(rationale, '{_CUE}') AS cue,
    coalesce(an <> '' AND an NOT IN ({_GENERIC}) AND (length(an) >= 4 OR contains(an, ' ') OR (regexp_matches(an, '[0-9]') AND length(an) >= 3)) AND contains({_LOOSE.format('rationale')}, {_LOOSE.format('answer')}), false) AS mentions FROM stem_v)"""


@query("QA12_clear_drift", """SELECT case_id, CASE WHEN reason = 'true_drift' THEN 'kept' ELSE 'cleared' END AS verdict, reason, prefixes, shared FROM (
  SELECT *, CASE WHEN mentions AND (cue OR same OR shared >= 1) THEN 'correct_option_mentioned' WHEN same AND shared >= 1 THEN 'synonym_match' WHEN prefixes >= 4 AND shared >= 4 AND 10 * shared >= 6 * prefixes THEN 'stem_overlap' ELSE 'true_drift' END AS reason FROM clear_v)""", (*SHORT, CLEAR))
def _(s, d):
    c = apart(s, d)
    return healing.clear_drift(c.select("case_id"), c, NAMES, STOP)
