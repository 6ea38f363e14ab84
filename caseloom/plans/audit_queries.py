"""Queries of the wide audits, over cases that have the damage the audits look for.

Texts, sources and options are those of the documents; some fields are left
out, cut or given a phrase by the case's number, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..operators import checks
from ..operators import full_audit as fa
from ..operators import healing, rationale
from . import views
from .queries import NORM, query
from .views import CASES_SQL

#: Phrases behind prompts and before explanations, by remainders of the case's number.
PROMPTS = {1: " Which is NOT TRUE except in the radiograph?", 2: " see **bold** text", 3: " <br> line", 4: " sugar of 12", 5: " blood sugar 110 mg/dL (", 6: " treated with ranitidine by JNC 7", 7: " which one of the", 8: " â€™quoted", 9: " tratamiento"}
LEADS = {
    1: "Ans. B. ", 2: "Ref: Harrison pg. 12 ", 3: "# one # two ", 4: "(Image) Extra mile ", 5: "The correct answer is (C) since ", 6: 'answer: "yes" and so on. ', 7: "this is the recommended one because ", 8: "it is true because of many things, as is said, ",
}
WHOLE = {10: "", 11: "explanation unavailable.", 12: "https://example.org/x", 13: "See reference.", 14: "short one", 15: None}


def _pick(number: Column, table: dict[int, str | None], fallback: Column) -> Column:
    out = fallback
    for k, text in table.items():
        out = F.when(number == k, F.lit(text).cast("string")).otherwise(out)
    return out


def rich(s, d) -> DataFrame:
    c = views.cases(s, d)
    i = F.col("case_id")
    sentence = lambda k: trimmed(F.get(F.split("question", "\\.", -1), F.lit(k)))
    option = lambda id_, text, right, votes: F.struct(F.lit(id_).cast("string").alias("id"), text.cast("string").alias("text"), right.cast("boolean").alias("is_correct"), votes.cast("int").alias("votes"))
    plain = F.filter(F.array(*[option("ABCD"[k], sentence(k), i % 4 == k, (i * (k + 1)) % 3) for k in range(4)]), lambda o: o["text"].isNotNull() & (o["text"] != ""))
    fixed = lambda texts, right: F.array(*[option("ABCDEFG"[k], F.lit(t), F.lit(k == right), F.lit(0)) for k, t in enumerate(texts)])
    panel = F.array(*[option(x, F.concat(F.lit("level "), F.lit(x)), i % 5 == k, (i + k) % 4) for k, x in enumerate(fa.PANEL_LABELS)])
    m = i % 31
    options = (
        F.when((i % 7 == 2) & (i % 3 == 0), panel).when(m == 1, F.array().cast("array<struct<id:string,text:string,is_correct:boolean,votes:int>>")).when(m == 2, F.slice(plain, 1, 1))
        .when(m == 3, fixed(["same"] * 3, 1)).when(m == 4, fixed(["Yes", "no", "maybe"], 0)).when(m == 5, fixed(["a and b", "always", "", "four", "five", "six", "seven"], 0)).otherwise(plain)
    )
    lead = F.concat(_pick(i % 37, LEADS, F.lit("")), F.when(i % 41 == 3, F.concat(F.coalesce(sentence(0), F.lit("")), F.lit(" is correct and the best answer. "))).otherwise(F.lit("")), F.col("rationale"))
    return c.select(
        "case_id",
        F.when(i % 29 == 3, "medexpqa").when(i % 29 == 5, "pubmedqa").when(i % 29 != 7, F.col("source")).alias("source"),
        F.when(i % 7 == 2, "SCT").when(i % 53 != 4, "MCQ").alias("q_type"),
        F.when(i % 11 != 0, F.substring(F.sha2(F.substring("question", 1, 60), 256), 1, 12)).alias("hash_id"),
        F.when(i % 41 == 3, F.concat("title", F.lit(" except?"))).when(i % 13 == 2, "").when(i % 13 != 1, F.col("title")).alias("question"),
        F.when(i % 17 == 1, F.lit(None)).when(i % 17 == 2, "What?").otherwise(F.concat("title", _pick(i % 23, PROMPTS, F.lit("?")))).alias("prompt"),
        F.when(i % 19 == 1, F.lit(None)).when(i % 19 == 2, "").when(i % 19 == 3, F.substring("question", 1, 20)).when(i % 19 == 4, F.concat(F.lit("A 50 year-old presents to you. Which one? "), "question")).otherwise(F.col("question")).alias("narrative"),
        F.when(i % 59 == 5, "").otherwise(F.col("title")).alias("title"),
        F.when(i % 61 == 7, F.lit(None)).when(i % 2 == 0, "surgery").otherwise(F.col("category")).alias("category"),
        F.when(i % 5 == 0, "USMLE").when(i % 5 == 1, "").otherwise(F.col("exam_type")).alias("exam_type"),
        F.when(i % 3 == 0, "a hypothesis").alias("hypothesis"),
        _pick(i % 37, WHOLE, lead).alias("rationale"),
        F.when(i % 43 == 1, F.array(F.concat(F.lit("./images/cases/p"), i.cast("string"), F.lit(".png")), F.lit("https://x/y.png"))).alias("images"),
        options.alias("options"),
        F.create_map(F.lit("A"), F.when(i % 47 == 2, "[Auto-Analysis] no").otherwise("fine")).alias("distractors"),
        (i % 10 == 5).alias("do_not_shuffle"),
    )


def _said(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _case(number: str, table: dict[int, str | None], fallback: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {k} THEN {_said(t)}" for k, t in table.items()) + f" ELSE {fallback} END"


def _fixed(texts: list[str], right: int) -> str:
    return "[" + ", ".join(f"{{'id': '{'ABCDEFG'[k]}', 'text': '{t}', 'is_correct': {str(k == right).lower()}, 'votes': 0}}" for k, t in enumerate(texts)) + "]"


_PLAIN = "list_filter(list_transform([1, 2, 3, 4], lambda k: {'id': substring('ABCD', k, 1), 'text': trim(string_split(question, '.')[k]), 'is_correct': i % 4 = k - 1, 'votes': CAST((i * k) % 3 AS INTEGER)}), lambda o: o.text IS NOT NULL AND o.text <> '')"
_PANEL = "[" + ", ".join(f"{{'id': '{x}', 'text': 'level {x}', 'is_correct': i % 5 = {k}, 'votes': CAST((i + {k}) % 4 AS INTEGER)}}" for k, x in enumerate(fa.PANEL_LABELS)) + "]"
_LEAD = f"{_case('i % 37', LEADS, _said(''))} || CASE WHEN i % 41 = 3 THEN coalesce(trim(string_split(question, '.')[1]), '') || ' is correct and the best answer. ' ELSE '' END || rationale"
PLAIN = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[''\"“”‘’`]', '', 'g'), '[^a-z0-9+/-]+', ' ', 'g'), ' ')"
RICH = f"""rich_v AS (SELECT i AS case_id, CASE WHEN i % 29 = 3 THEN 'medexpqa' WHEN i % 29 = 5 THEN 'pubmedqa' WHEN i % 29 <> 7 THEN source END AS source, CASE WHEN i % 7 = 2 THEN 'SCT' WHEN i % 53 <> 4 THEN 'MCQ' END AS q_type,
    CASE WHEN i % 11 <> 0 THEN substring(sha256(substring(question, 1, 60)), 1, 12) END AS hash_id, CASE WHEN i % 41 = 3 THEN title || ' except?' WHEN i % 13 = 2 THEN '' WHEN i % 13 <> 1 THEN title END AS question,
    CASE WHEN i % 17 = 1 THEN NULL WHEN i % 17 = 2 THEN 'What?' ELSE title || {_case('i % 23', PROMPTS, _said('?'))} END AS prompt,
    CASE WHEN i % 19 = 1 THEN NULL WHEN i % 19 = 2 THEN '' WHEN i % 19 = 3 THEN substring(question, 1, 20) WHEN i % 19 = 4 THEN 'A 50 year-old presents to you. Which one? ' || question ELSE question END AS narrative,
    CASE WHEN i % 59 = 5 THEN '' ELSE title END AS title, CASE WHEN i % 61 = 7 THEN NULL WHEN i % 2 = 0 THEN 'surgery' ELSE category END AS category, CASE i % 5 WHEN 0 THEN 'USMLE' WHEN 1 THEN '' ELSE exam_type END AS exam_type,
    CASE WHEN i % 3 = 0 THEN 'a hypothesis' END AS hypothesis, {_case('i % 37', WHOLE, _LEAD)} AS rationale, i % 43 = 1 AS has_images, i % 47 = 2 AS auto, i % 10 = 5 AS do_not_shuffle,
    CASE WHEN i % 7 = 2 AND i % 3 = 0 THEN {_PANEL} WHEN i % 31 = 1 THEN [] WHEN i % 31 = 2 THEN ({_PLAIN})[1:1] WHEN i % 31 = 3 THEN {_fixed(['same'] * 3, 1)} WHEN i % 31 = 4 THEN {_fixed(['Yes', 'no', 'maybe'], 0)}
      WHEN i % 31 = 5 THEN {_fixed(['a and b', 'always', '', 'four', 'five', 'six', 'seven'], 0)} ELSE {_PLAIN} END AS o FROM (SELECT *, case_id AS i FROM cases_v)),
  told_v AS (SELECT *, trim(coalesce(narrative, '') || ' ' || coalesce(prompt, '')) AS f, coalesce(rationale, '') AS r, len(o) AS n, list_filter(o, lambda x: x.is_correct) AS rt, list_filter(o, lambda x: NOT x.is_correct) AS wr,
    coalesce(nullif(trim(coalesce(question, '')), ''), nullif(trim(coalesce(narrative, '')), ''), nullif(trim(coalesce(prompt, '')), ''), nullif(trim(coalesce(title, '')), ''), '') AS q FROM rich_v)"""
VIEWS = (CASES_SQL, RICH)


def _rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '" + pattern.replace("'", "''") + "')"


def _any(lists: str, cond: str) -> str:
    return f"len(list_filter({lists}, lambda x: {cond})) > 0"


def _rows(layer: str, view: str, checks: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT case_id, '{layer}' AS layer, '{c}' AS code, '{s}' AS severity FROM {view} WHERE {p}" for c, s, p in checks)


_SHORT = "length(f) BETWEEN 1 AND 199"
_TWICE = lambda key: f"{key} IN (SELECT {key} FROM told_v WHERE {key} <> '' GROUP BY {key} HAVING count(*) > 1)"
A_SQL = [
    ("few_options", "critical", "n < 2"), ("no_correct", "critical", "q_type = 'MCQ' AND len(rt) = 0"), ("multi_correct", "medium", "q_type = 'MCQ' AND len(rt) > 1"),
    ("empty_question", "critical", "length(coalesce(narrative, '')) < 10 AND length(coalesce(prompt, '')) < 10"), ("brackets", "medium", f"{_SHORT} AND length(replace(f, '(', '')) <> length(replace(f, ')', ''))"),
    ("trailing_stop_word", "medium", f"{_SHORT} AND {_rx('f', fa.TRAILING)}"), ("no_terminal", "low", "length(f) BETWEEN 1 AND 79 AND NOT regexp_matches(f, '[.?!:\")]$')"),
    ("phantom_image", "medium", f"{_rx('f', fa.PHANTOM)} AND NOT has_images"), ("empty_option", "medium", _any("o", "trim(x.text) = ''")), ("duplicate_hash", "medium", _TWICE("hash_id")),
    ("bad_category", "low", f"category IS NULL OR category NOT IN ({', '.join(map(_said, fa.CATEGORIES))})"),
]


@query("QA01_layer_a", _rows("A", "told_v", A_SQL), VIEWS)
def _(s, d):
    return fa.audit_structure(rich(s, d))


_ALL = "concat_ws(' ', lq, rt[1].text, CASE WHEN len(wr) = 0 THEN '' ELSE array_to_string(list_transform(wr, lambda x: x.text), ' ') END, lower(r))"
WATCH = (*VIEWS, f"watch_v AS (SELECT *, {_ALL} AS everything, regexp_extract(lq, '{fa.AMOUNT}', 1) AS amount, regexp_extract(lq, '{fa.AMOUNT}', 2) AS unit, {_any('o', _rx('x.text', fa.POISON))} AS poison, list_avg(list_transform(wr, lambda x: length(x.text))) AS mean FROM (SELECT *, lower(coalesce(nullif(narrative, ''), prompt, '')) AS lq FROM told_v WHERE q_type = 'MCQ' AND n >= 2 AND len(rt) > 0))")
S_SQL = [
    ("length_bias", "medium", "mean > 5 AND length(rt[1].text) > 1.8 * mean"), ("absolute_trap", "low", _any("wr", _rx("x.text", fa.ABSOLUTE))), ("shuffle_poison", "high", "poison AND NOT do_not_shuffle"), ("kept_in_order", "low", "poison AND do_not_shuffle"),
    ("negation_blind", "high", f"{_rx('lq', fa.NEGATION)} AND length(r) > 50 AND {_rx('lower(r)', fa.AFFIRMS)}"), ("withdrawn_drug", "high", _rx("everything", fa.WITHDRAWN)), ("outdated_guideline", "medium", _rx("everything", fa.OUTDATED)),
    ("unitless_glucose", "medium", f"{_rx('lq', fa.SUGAR)} AND amount <> '' AND unit = '' AND try_cast(amount AS DOUBLE) < 30"),
]


@query("QA15_watchman", _rows("S", "watch_v", S_SQL), WATCH)
def _(s, d):
    return fa.screening(rich(s, d))


_LOWS = "list_transform(o, lambda x: lower(trim(x.text)))"
X_SQL = [
    ("missing_id", "critical", "case_id IS NULL"), ("missing_qtype", "high", "q_type IS NULL"), ("missing_category", "medium", "category IS NULL"), ("missing_title", "low", "title = ''"), ("missing_narrative", "medium", "narrative IS NULL"),
    ("empty_narrative", "medium", "narrative = ''"), ("short_narrative", "low", "q_type = 'MCQ' AND length(narrative) BETWEEN 1 AND 29"), ("missing_prompt", "medium", "coalesce(prompt, '') = ''"), ("missing_options", "critical", "n = 0"), ("few_options", "critical", "n = 1"),
    ("no_correct_answer", "critical", "len(rt) = 0"), ("multiple_correct", "high", "q_type = 'MCQ' AND len(rt) > 1"), ("missing_source", "medium", "source IS NULL"), ("duplicate_ids", "critical", "case_id IN (SELECT case_id FROM told_v GROUP BY case_id HAVING count(*) > 1)"), ("duplicate_hashes", "high", _TWICE("hash_id")),
    ("duplicate_narratives", "medium", "length(nk) > 50 AND nk IN (SELECT nk FROM deep_v GROUP BY nk HAVING count(*) > 1)"), ("identical_options", "high", f"len(list_distinct({_LOWS})) < n"), ("option_is_empty", "high", _any("o", "trim(x.text) = ''")), ("very_long_option", "low", _any("o", "length(x.text) > 500")),
    ("narrative_has_question_stem", "low", f"q_type = 'SCT' AND {_rx('narrative', fa.STEM)}"), ("raw_markdown_in_text", "low", _rx("f", fa.MARKDOWN)), ("html_in_text", "medium", _rx("f", fa.MARKUP)),
    ("sct_missing_hypothesis", "high", "q_type = 'SCT' AND hypothesis IS NULL AND NOT regexp_matches(coalesce(narrative, ''), '[Hh]ipotesis')"), ("sct_no_panel_votes", "high", f"q_type = 'SCT' AND NOT {_any('o', 'x.votes > 0')}"), ("sct_bad_likert", "high", "q_type = 'SCT' AND len(rt) = 0"),
    ("sct_english_vignette", "low", f"q_type = 'SCT' AND {_rx('substring(narrative, 1, 200)', fa.ENGLISH)}"), ("no_explanation", "medium", "r = ''"), ("very_short_explanation", "low", "length(r) BETWEEN 1 AND 19"), ("dirty_explanation_ans_prefix", "low", r"regexp_matches(r, '(?i)^Ans\.\s*[A-Za-z]')"),
    ("dirty_explanation_ref", "low", rf"regexp_matches(r, '(?i)Ref[;:]\s') OR {_rx('r', fa.BOOKS)}"), ("dirty_explanation_hash_sep", "low", "length(r) - length(replace(r, '#', '')) >= 2"), ("dirty_explanation_image_ref", "low", r"regexp_matches(r, '(?i)\(Image\)')"),
    ("dirty_explanation_extra_mile", "low", "contains(lower(r), 'extra mile')"), ("dirty_explanation_page_ref", "low", r"regexp_matches(r, '(?i)pg\.\s*\d+')"), ("explanation_very_long", "low", "length(r) > 2000"), ("auto_analysis_hallucination", "medium", "auto"),
    ("missing_exam_type", "low", "exam_type = ''"), ("unknown_exam_type", "low", f"exam_type <> '' AND exam_type NOT IN ({', '.join(map(_said, fa.EXAM_TYPES))})"), ("phantom_image", "medium", f"{_rx('f', fa.PHANTOM_DEEP)} AND NOT has_images"), ("has_images", "low", "has_images"),
]
DEEP = (*VIEWS, "deep_v AS (SELECT *, substring(trim(lower(coalesce(narrative, ''))), 1, 200) AS nk FROM told_v)")


@query("QA17_fields", _rows("X", "deep_v", X_SQL), DEEP)
def _(s, d):
    return fa.deep_audit(rich(s, d))


_P = PLAIN.format
_TEXTS = f"list_transform(o, lambda x: {_P('x.text')})"
_LETTER = lambda k: f"upper(regexp_extract(tr, '{fa.LETTERS[k]}', 1))"
_BY_LETTER = lambda k: f"CASE WHEN {_LETTER(k)} <> '' THEN coalesce(list_position(list_transform(o, lambda x: upper(trim(x.id))), {_LETTER(k)}) - 1, CASE WHEN ascii({_LETTER(k)}) - 65 < n THEN ascii({_LETTER(k)}) - 65 END) END"
_TEXT = lambda k: _P("regexp_extract(tr, '" + fa.TEXTS[k].replace("'", "''") + "', 1)")
_FITS = lambda k: f"list_filter(range(1, n + 1), lambda j: ts[j] <> '' AND (contains({_TEXT(k)}, ts[j]) OR contains(ts[j], {_TEXT(k)})))"
_BY_TEXT = lambda k: f"CASE WHEN {_TEXT(k)} <> '' AND len({_FITS(k)}) = 1 THEN ({_FITS(k)})[1] - 1 END"
_WINDOW = lambda t, around: f"substring(pr, greatest(instr(pr, {t}) - {around}, 1), instr(pr, {t}) + length({t}) + {around} - greatest(instr(pr, {t}) - {around}, 1))"
_CUED = f"(list_filter(range(1, n + 1), lambda j: length(ts[j]) BETWEEN 5 AND 120 AND contains(pr, ts[j]) AND {_rx(_WINDOW('ts[j]', 30), fa.CUE)} AND {_rx(_WINDOW('ts[j]', 30), fa.COPULA)}))[1] - 1"
FULL = (*VIEWS, f"""texts_v AS (SELECT *, {_TEXTS} AS ts, {_P('r')} AS pr, trim(r) AS tr, {_P('q')} AS pq, len(rt) = 1 AS single, CASE WHEN len(rt) = 1 THEN {_P('rt[1].text')} END AS kt, array_to_string(list_transform(o, lambda x: x.text), ' ') AS said,
    substring({_P('q')}, 1, 80) AS px, lower(coalesce(source, '')) AS src, trim(coalesce(nullif(question, ''), prompt, '')) AS qp, list_position(list_transform(o, lambda x: x.is_correct), true) - 1 AS at_key FROM told_v),
  full_v AS (SELECT *, coalesce({_BY_LETTER(0)}, {_BY_LETTER(1)}, {_BY_TEXT(0)}, {_BY_TEXT(1)}, {_CUED}) AS named FROM texts_v)""")
F_SQL = [
    ("rationale_contradicts_answer", "critical", "single AND named <> at_key"),
    ("except_logic_suspect", "high", f"single AND {_rx('q', fa.NEGATIVE_QUESTION)} AND length(kt) >= 5 AND contains(pr, kt) AND NOT {_rx(_WINDOW('kt', 40), fa.NEGATIVE_CONTEXT)} AND {_rx(_WINDOW('kt', 40), fa.POSITIVE_CONTEXT)}"),
    ("duplicate_question", "high", "px IN (SELECT px FROM texts_v WHERE length(px) >= 25 GROUP BY px HAVING count(DISTINCT case_id) > 1 AND count(DISTINCT source) > 1)"),
    ("encoding_broken", "high", _rx("concat_ws(' ', question, prompt, narrative, said)", fa.ENCODING)), ("mixed_language", "medium", f"src <> 'medexpqa' AND {_rx(chr(39).join(['concat_ws(', ' ', ', q, said, tr)']), fa.MIXED)}"),
    ("no_question_text", "critical", "trim(coalesce(question, '')) || trim(coalesce(prompt, '')) || trim(coalesce(narrative, '')) = ''"), ("no_option_text", "critical", f"NOT {_any('o', chr(39).join(['trim(x.text) <> ', '']) + chr(39))}"),
    ("question_too_short", "medium", "trim(coalesce(narrative, '')) = '' AND length(q) BETWEEN 1 AND 14"), ("broken_image", "medium", "has_images AND case_id % 4 <> 0"),
    ("sct_missing_votes", "high", "q_type = 'SCT' AND len(list_filter(o, lambda x: x.votes > 0)) < 2"), ("sct_wrong_option_count", "high", "q_type = 'SCT' AND NOT (n = 5 AND o[1].id = '-2')"), ("sct_no_rationale", "medium", "q_type = 'SCT' AND tr = ''"),
    ("medexpqa_incomplete", "high", f"src = 'medexpqa' AND (n = 0 OR {_any('o', chr(39).join(['trim(x.text) = ', '']) + chr(39))} OR NOT single OR length(qp) <= 30)"),
    ("pubmedqa_incomplete", "high", "src = 'pubmedqa' AND (n <> 3 OR list_sort(list_distinct(ts)) <> ['maybe', 'no', 'yes'] OR NOT single OR NOT ends_with(qp, '?'))"),
    ("all_options_same", "critical", "n > 1 AND len(list_filter(ts, lambda x: x = '')) = 0 AND len(list_distinct(ts)) = 1"), ("answer_in_question", "medium", "single AND length(kt) >= 8 AND contains(pq, kt)"), ("single_option", "critical", "n = 1"), ("too_many_options", "low", "n > 6"),
    ("no_rationale", "medium", _rx("tr", fa.UNAVAILABLE)), ("rationale_too_short", "low", "length(tr) < 10"), ("rationale_placeholder", "low", f"{_rx('tr', fa.URL_ONLY)} OR {_rx('tr', fa.PLACEHOLDER)}"),
]


@query("QA07_full_audit", _rows("F", "full_v", F_SQL), FULL)
def _(s, d):
    """Images of every fourth case are there."""
    cases = rich(s, d)
    files = cases.where("case_id % 4 = 0 and images is not null").select(F.concat(F.lit("p"), F.col("case_id").cast("string"), F.lit(".png")).alias("name"))
    return fa.full_audit(cases, files)


def repaired(s, d) -> DataFrame:
    i = F.col("case_id")
    return rich(s, d).withColumns({"antidote": i % 9 == 0, "needs_regen": i % 9 == 3, "regenerated": i % 18 == 3, "case_code": F.when(i % 71 != 2, F.concat(F.lit("C"), F.floor(i / F.when(i % 73 == 1, 2).otherwise(1)).cast("string")))})


_W = lambda text, least: f"list_filter(regexp_extract_all(lower({text}), '\\b[a-z]+\\b'), lambda w: length(w) >= {least})"
_H = lambda words: f"len(list_filter({words}, lambda w: contains(lr, w)))"
_PRINT = "array_to_string(list_sort(list_transform(o, lambda x: substring(lower(trim(x.text)), 1, 30))), '|')"
SMOKE = (*VIEWS, f"""smoke_v AS (SELECT *, lower(r) AS lr, {_W("coalesce(rt[1].text, '')", 4)} AS kw, coalesce(nullif(narrative, ''), nullif(prompt, ''), '') AS sq, {_LOWS} AS lt, {_PRINT} AS fp FROM told_v),
  mark_v AS (SELECT *, coalesce(q_type = 'MCQ' AND len(rt) > 0 AND length(lr) >= 30, false) AS explained, (len(kw) = 0 OR {_H('kw')} > 0) AND NOT {_any('wr', f"len({_W('x.text', 5)}) >= 2 AND {_H(_W('x.text', 5))} > {_H('kw')} + 2")} AS coherent FROM smoke_v),
  rawkey_v AS (SELECT fp, min_by(CASE WHEN case_id % 6 = 0 THEN 'B' ELSE rt[1].id END, case_id) AS k FROM smoke_v WHERE case_id % 4 <> 1 AND source = 'src0' GROUP BY fp),
  cross_v AS (SELECT k, rt[1].id AS own FROM smoke_v m LEFT JOIN rawkey_v USING (fp) WHERE source = 'src0'),
  source_v AS (SELECT coalesce(source, 'unknown') AS name, count(*) AS n, count(*) FILTER (length(lr) > 20) AS rr, count(*) FILTER (len(rt) > 0) AS kk, min_by(len(rt) > 0 AND length(lr) > 30, case_id) AS first FROM smoke_v GROUP BY 1)""")
_LAYERS = [
    (1, "no_question", "sq = ''", False), (1, "no_options", "n < 2", False), (1, "no_correct", "n >= 2 AND len(rt) = 0", False), (1, "multi_correct", "n >= 2 AND len(rt) > 1", True), (1, "empty_option_text", "n >= 2 AND list_contains(lt, '')", False),
    (3, "coherent", "explained AND coherent", True), (3, "suspicious", "explained AND NOT coherent", False), (3, "no_rationale", "q_type = 'MCQ' AND NOT explained", True),
    (6, "antidoted_with_rationale", "case_id % 9 = 0 AND length(lr) > 30", True), (6, "antidoted_without", "case_id % 9 = 0 AND length(lr) <= 30", False), (6, "needs_regen", "case_id % 9 = 3", True), (6, "regenerated", "case_id % 18 = 3", True),
    (7, "very_short_question", "q_type = 'MCQ' AND length(sq) < 20", False), (7, "truncated_vignette", "ends_with(sq, '...')", False), (7, "html_in_text", "regexp_matches(sq, '(?i)<[a-z]+>')", False), (7, "duplicate_options", "len(list_distinct(lt)) < n", False), (7, "all_same_options", "n >= 2 AND len(list_distinct(lt)) = 1", False),
]


@query("QA21_smoke_layers", " UNION ALL ".join(f"SELECT {layer} AS layer, '{name}' AS name, count(*) FILTER ({p}) AS n, {'true' if good else f'count(*) FILTER ({p}) = 0'} AS passed FROM mark_v" for layer, name, p, good in _LAYERS) + """
  UNION ALL SELECT 1, 'duplicate_ids', count(*) - count(DISTINCT case_id), count(*) = count(DISTINCT case_id) FROM smoke_v
  UNION ALL SELECT 2, 'matched', count(*) FILTER (k = own), true FROM cross_v UNION ALL SELECT 2, 'mismatch', count(*) FILTER (k IS NOT NULL AND k IS DISTINCT FROM own), count(*) FILTER (k IS NOT NULL AND k IS DISTINCT FROM own) = 0 FROM cross_v UNION ALL SELECT 2, 'not_found', count(*) FILTER (k IS NULL), true FROM cross_v
  UNION ALL SELECT 4, name, n, kk = n AND 2 * rr >= n FROM source_v UNION ALL SELECT 5, name, 1, first FROM (SELECT * FROM source_v ORDER BY n DESC, name LIMIT 5)""", SMOKE)
def _(s, d):
    """Raw records of the largest source: three cases in four, every sixth with another key."""
    c = repaired(s, d)
    key = F.when(F.col("case_id") % 6 == 0, "B").otherwise(F.get(F.filter("options", lambda o: o["is_correct"]), F.lit(0))["id"])
    raw = c.where("case_id % 4 <> 1 and source = 'src0'").select(checks.option_print(F.col("options")).alias("fp"), key.alias("key"), F.col("case_id").alias("pos"))
    return checks.smoke_layers(c, raw, "src0")


_CODE = "CASE WHEN case_id % 71 <> 2 THEN 'C' || CAST(CASE WHEN case_id % 73 = 1 THEN case_id // 2 ELSE case_id END AS VARCHAR) END"
PUBLISH = (*VIEWS, f"code_v AS (SELECT *, {_CODE} AS code, coalesce(nullif(prompt, ''), nullif(question, ''), nullif(narrative, ''), '') AS p FROM told_v)", "held_v AS (SELECT CASE WHEN case_id % 100 = 3 THEN 'x' ELSE CAST(case_id + CASE WHEN case_id % 100 = 5 THEN 100000000 ELSE 0 END AS VARCHAR) END AS id FROM cases_v WHERE case_id % 100 < 7 UNION ALL SELECT CAST(case_id AS VARCHAR) FROM cases_v WHERE case_id % 100 = 1)")
_N2 = NORM.format
_STATED = "regexp_extract(r, '" + healing.STATEMENT.replace("'", "''") + "([\\s\\S]{0,120})', 1)"
HARD = f"""hard_v AS (SELECT case_id, list_min(list_filter(list_transform(range(1, n + 1), lambda j: {{'at': instr(said, {_N2('o[j].text')}), 'n': -length({_N2('o[j].text')}), 'j': j}}), lambda p: p['at'] > 0 AND p['n'] <= -3)).j AS j, o, rt
    FROM (SELECT *, {_N2("regexp_extract(w, '^[^\\n;]*')")} AS said FROM (SELECT *, {_STATED} AS w FROM told_v WHERE n >= 2) WHERE w <> '' AND NOT regexp_matches(substring(w, 1, 12), '(?i)^\\s*(?:>|<|/|&|,|and\\b|or\\b)'))
    WHERE case_id NOT IN (SELECT try_cast(id AS BIGINT) FROM held_v WHERE try_cast(id AS BIGINT) IS NOT NULL))"""
PUBLISH = (*PUBLISH, HARD)
_P_SQL = [
    ("missing_id", "count(*) FILTER (case_id IS NULL)"), ("missing_case_code", "count(*) FILTER (code IS NULL)"), ("prompt_too_short", "count(*) FILTER (length(trim(p)) < 10)"), ("bad_option_count", "count(*) FILTER (n NOT BETWEEN 2 AND 5)"), ("bad_correct_count", "count(*) FILTER (len(rt) <> 1)"),
    ("empty_option_text", "sum(len(list_filter(o, lambda x: trim(x.text) = '')))"), ("option_too_long", "sum(len(list_filter(o, lambda x: length(x.text) > 1500)))"), ("unexplained_beyond_five_percent", "CASE WHEN count(*) FILTER (r <> '') < 0.95 * count(*) THEN count(*) FILTER (r = '') ELSE 0 END"),
]


@query("QA22_publish_checks", "SELECT name, CAST(n AS BIGINT) AS n, n = 0 AS passed FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name, {count} AS n FROM code_v" for name, count in _P_SQL) + """
  UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT case_id FROM code_v GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'duplicate_case_codes', count(*) FROM (SELECT code FROM code_v WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'manifest_non_numeric', count(*) FROM held_v WHERE try_cast(id AS BIGINT) IS NULL UNION ALL SELECT 'manifest_unknown', count(DISTINCT id) FROM held_v WHERE try_cast(id AS BIGINT) NOT IN (SELECT case_id FROM code_v)
  UNION ALL SELECT 'manifest_duplicate', count(try_cast(id AS BIGINT)) - count(DISTINCT try_cast(id AS BIGINT)) FROM held_v UNION ALL SELECT 'hard_contradictions', count(*) FROM hard_v WHERE len(rt) > 0 AND HARDER)""".replace("HARDER", f"{_N2('o[j].text')} <> {_N2('rt[1].text')}"), PUBLISH)
def _(s, d):
    """A manifest of seven cases in a hundred, with entries that are no number, unknown or repeated."""
    c = repaired(s, d)
    i = F.col("case_id")
    held = c.where(i % 100 < 7).select(F.when(i % 100 == 3, "x").otherwise((i + F.when(i % 100 == 5, 100000000).otherwise(0)).cast("string")).alias("id"))
    return checks.publish_checks(c, held.unionByName(c.where(i % 100 == 1).select(i.cast("string").alias("id"))))


_WS = lambda text: f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-z0-9]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3))"
BLIND = (*VIEWS, f"blind_v AS (SELECT *, length(rt[1].text) AS c, list_avg(list_transform(wr, lambda x: length(x.text))) AS w, list_position(list_transform(o, lambda x: x.is_correct), true) - 1 AS at_key, {_WS('f')} AS stem FROM told_v WHERE len(rt) > 0 AND len(wr) > 0)", f"blinder_v AS (SELECT *, len(list_intersect(stem, {_WS('rt[1].text')})) AS sh, list_max(list_transform(wr, lambda x: len(list_intersect(stem, {_WS('x.text')})))) AS best FROM blind_v)")
_N = lambda lists, pattern: f"len(list_filter({lists}, lambda x: {_rx('x.text', pattern)}))"


@query("AG12_blindspots", f"""SELECT count(*) AS cases, round(avg(c), 4) AS mean_right, round(avg(w), 4) AS mean_wrong, count(*) FILTER (c > 1.5 * w) AS longer_right, count(*) FILTER (c < 0.6 * w) AS shorter_right, count(*) FILTER ({_rx("coalesce(prompt, '')", checks.NEGATIVE)}) AS negative_prompts,
  CAST(sum({_N('o', checks.ALL_ABOVE)}) AS BIGINT) AS all_of_the_above, CAST(sum({_N('o', checks.NONE_ABOVE)}) AS BIGINT) AS none_of_the_above, count(*) FILTER ({_N('o', checks.ABSOLUTE)} > 0) AS absolute_terms, CAST(sum({_N('rt', checks.ABSOLUTE)}) AS BIGINT) AS absolute_right, CAST(sum({_N('wr', checks.ABSOLUTE)}) AS BIGINT) AS absolute_wrong,
  {', '.join(f'count(*) FILTER (at_key = {k}) AS key_at_{k}' for k in range(5))}, count(*) FILTER (at_key > 4) AS key_at_other, count(*) FILTER (sh > best AND sh > 0) AS word_match_cue, count(*) FILTER ({_rx('r', checks.CIRCULAR)} AND length(r) < 150) AS circular_rationale FROM blinder_v""", BLIND)
def _(s, d):
    return checks.psychometrics(rich(s, d))


_SQ = "coalesce(nullif(question, ''), nullif(narrative, ''), title, '')"
@query("FL05_quarantine_reasons", rf"""SELECT case_id, reason FROM (SELECT case_id, CASE WHEN length(trim(t)) < 20 THEN 'too_short' WHEN length(regexp_replace(t, '[^A-Za-z]', '', 'g')) > 40 AND length(regexp_replace(t, '[^A-Z]', '', 'g')) * 10 > length(regexp_replace(t, '[^A-Za-z]', '', 'g')) * 8 THEN 'garbled_caps'
    WHEN regexp_matches(t, '\x{{FFFD}}{{2,}}|(Ã.){{3,}}') THEN 'encoding_garbage' WHEN regexp_matches(trim(t), '[,;(]$') THEN 'truncated' WHEN five THEN 'repetitive' WHEN length(t) > 60 AND nw * 30 < length(t) THEN 'no_spaces' WHEN n < 2 OR len(rt) = 0 THEN 'no_correct_answer' END AS reason
  FROM (SELECT case_id, t, n, rt, len(list_filter(string_split_regex(trim(t), '\s+'), lambda x: x <> '')) AS nw, len(list_filter(range(1, len(ws) - 3), lambda j: regexp_matches(ws[j], '^\w+$') AND ws[j] = ws[j + 1] AND ws[j] = ws[j + 2] AND ws[j] = ws[j + 3] AND ws[j] = ws[j + 4])) > 0 AS five
    FROM (SELECT case_id, {_SQ} AS t, n, rt, string_split(lower({_SQ}), ' ') AS ws FROM told_v))) WHERE reason IS NOT NULL""", VIEWS)
def _(s, d):
    return checks.quarantine_reason(rich(s, d))


@query("QA09_except_trap", r"""SELECT case_id FROM (SELECT case_id, question, lower(r) AS lr, lower(rt[1].text) AS k FROM told_v) WHERE regexp_matches(lower(question), '\b(except|not|incorrect|false|least likely)\b') AND length(k) > 3 AND contains(lr, k)
  AND regexp_matches(substring(lr, greatest(instr(lr, k) - 40, 1), length(k) + 80), '\b(is true|is correct|is seen|is associated|are seen)\b')""", VIEWS)
def _(s, d):
    return rationale.except_trap(rich(s, d))


#: Protocols told in the words of the texts.
LOCAL = [("first", " (the|der) ", " (of|und|des) ", " (best|wer) "), ("second", " (les|que) ", " (dans|pour) ", " (sur|une) ")]


def treated(s, d) -> DataFrame:
    """Prompts of every seventh case ask for the next step in an appendicitis; of these every second answer operates."""
    i = F.col("case_id")
    c = rich(s, d)
    cut_out = F.transform("options", lambda o: F.struct(o["id"].alias("id"), F.when(o["is_correct"] & (i % 14 == 0), F.concat(o["text"], F.lit(" by surgery"))).otherwise(o["text"]).alias("text"), o["is_correct"].alias("is_correct"), o["votes"].alias("votes")))
    return c.withColumn("prompt", F.when(i % 7 == 0, F.concat("title", F.lit(" has appendicitis: next step?"))).otherwise(F.col("prompt"))).withColumn("exam_type", F.when(i % 5 == 2, fa.LOCAL_EXAM).otherwise(F.col("exam_type"))).withColumn("options", cut_out)


_TREATED = """treat_v AS (SELECT *, coalesce(rt[1].text || CASE WHEN case_id % 14 = 0 THEN ' by surgery' ELSE '' END, '') AS ans, CASE WHEN case_id % 7 = 0 THEN title || ' has appendicitis: next step?' ELSE coalesce(prompt, '') END AS p2 FROM told_v WHERE case_id % 5 <> 2),
  local_v AS (SELECT *, ans || ' ' || r AS tx, concat_ws(' ', coalesce(narrative, ''), p2, array_to_string(list_transform(o, lambda x: x.text || CASE WHEN x.is_correct AND case_id % 14 = 0 THEN ' by surgery' ELSE '' END), ' '), r) AS ax FROM treat_v)"""


@query("QA04_layer_d", " UNION ALL ".join(f"SELECT case_id, 'D' AS layer, '{n}' AS code, 'medium' AS severity FROM local_v WHERE {_rx('ax', '(?i)' + a)} AND {_rx('tx', '(?i)' + b)} AND NOT {_rx('tx', '(?i)' + c)}" for n, a, b, c in LOCAL)
    + f" UNION ALL SELECT case_id, 'D', 'refer_not_operate', 'medium' FROM local_v WHERE {_rx('ax', '(?i)' + fa.REFERRED)} AND {_rx('ans', '(?i)' + fa.OPERATES)} AND {_rx('p2', '(?i)' + fa.ASKS)}", (*VIEWS, _TREATED))
def _(s, d):
    return fa.localization(treated(s, d), LOCAL)
