"""Further queries: text functions, quality audits, rationales, parsers and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, scoring, text
from ..operators import audit, category, contradictions, keys, quality, rationale, report
from ..sources import io, parse
from . import views
from .queries import ANSWERS, ALNUM, AUDIT, BOTH, NORM, answers, query, raw_rows
from .views import CASES_SQL, FEEDBACK_SQL, OPTIONS_SQL, TELEMETRY_SQL


def cased(s, d):
    return views.cases_with_options(s, d)


def union(checks, layer):
    return " UNION ALL ".join(f"SELECT case_id, '{layer}' AS layer, '{c}' AS code, '{v}' AS severity FROM agg_v WHERE {p}" for c, v, p in checks)


NORM_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{00A0}}\x{{FEFF}}]+', ''), '[\s\x{{00A0}}\x{{FEFF}}]+$', '')"


@query("FN01_norm_ws", f"SELECT case_id, {NORM_WS.format('question')} AS normal FROM cases_v")
def _(s, d):
    return views.cases(s, d).select("case_id", text.norm_ws("question").alias("normal"))


@query("FN03_display_text")
def _(s, d):
    return views.table(s, d, "pages").select("page_id", clean.decode_entities(text.display_text("html")).alias("shown"))


@query("FN04_mojibake", "SELECT case_id, question AS mended FROM cases_v")
def _(s, d):
    """Every text, with each character of the list beyond ASCII, and apostrophes, in their damaged form, and mended."""
    damaged = F.col("question")
    for wrong, right in text.MOJIBAKE:
        if wrong == "â€™" or not right.isascii():
            damaged = F.replace(damaged, F.lit(right), F.lit(wrong))
    return views.cases(s, d).select("case_id", text.fix_mojibake(damaged).alias("mended"))


@query("FN05_clean_explanation")
def _(s, d):
    return views.cases(s, d).select("case_id", clean.clean_explanation(F.col("question")).alias("clean"))


@query("FN06_clean_narrative")
def _(s, d):
    return views.cases(s, d).select("case_id", clean.expand_abbreviations(clean.clean_narrative(F.col("question")), {"th": "the", "nd": "and"}).alias("clean"))


@query("FN07_age", "SELECT case_id, case_id % 90 AS years FROM cases_v")
def _(s, d):
    return views.cases(s, d).select("case_id", text.age(F.concat(F.lit("A "), F.col("case_id") % 90, F.lit("-year-old. "), F.col("title"))).cast("long").alias("years"))


@query("FN09_titles")
def _(s, d):
    c = views.cases(s, d)
    return c.select("case_id", text.first_sentence("question").alias("title"), clean.smart_title(F.col("question"), F.col("difficulty") * 10, F.lit("f")).alias("smart"))


@query(
    "FN13_lengths",
    r"""SELECT case_id, n AS words, CASE WHEN n <= 50 THEN 'short' WHEN n <= 150 THEN 'medium' ELSE 'long' END AS bucket, neg AS negative_stem FROM (SELECT case_id, len(list_filter(regexp_split_to_array(question, '\s+'), lambda w: w <> '')) AS n,
    len(list_intersect(string_split(NORMAL, ' '), ['not', 'except', 'nicht', 'pas', 'sauf', 'no'])) > 0 AS neg FROM cases_v)""".replace("NORMAL", NORM.format("question")),
)
def _(s, d):
    return report.text_lengths(views.cases(s, d))


MARKERS = {"it": ["para", "las"], "fr": ["est", "les"], "de": ["und", "die"]}


@query(
    "FN14_language",
    "SELECT case_id, CASE len(l) WHEN 0 THEN 'en' WHEN 1 THEN l[1] ELSE 'mixed' END AS language FROM (SELECT case_id, list_filter(["
    + ", ".join(f"CASE WHEN len(list_intersect(w, {ws!r})) > 0 THEN '{n}' END" for n, ws in MARKERS.items())
    + f"], lambda x: x IS NOT NULL) AS l FROM (SELECT case_id, string_split({NORM.format('question')}, ' ') AS w FROM cases_v))",
)
def _(s, d):
    return views.cases(s, d).select("case_id", clean.language(F.col("question"), MARKERS).alias("language"))


@query("FN15_normalize_options")
def _(s, d):
    fixed = clean.normalize_options(F.col("options"))
    return cased(s, d).select("case_id", F.array_join(F.transform(fixed, lambda o: o["text"]), "|").alias("texts"), clean.option_review_reason(fixed).alias("reason"))


@query("FN17_image_type", "SELECT case_id, CASE WHEN regexp_matches(t, '\\bmri\\b') THEN 'mri' WHEN regexp_matches(t, '\\b(photo|picture|image|gambar)\\b') THEN 'photo' END AS kind FROM (SELECT case_id, lower(CASE case_id % 3 WHEN 0 THEN 'an MRI ' WHEN 1 THEN 'the picture ' ELSE '' END) AS t FROM cases_v)")
def _(s, d):
    i = F.col("case_id") % 3
    return views.cases(s, d).select("case_id", clean.image_type(F.when(i == 0, "an MRI ").when(i == 1, "the picture ").otherwise("")).alias("kind"))


@query("FN18_search_key", "SELECT case_id, lower(substring(title, 1, 60) || ' ' || substring(question, 1, 120) || ' ' || category || ' ' || source) AS key FROM cases_v")
def _(s, d):
    return views.cases(s, d).select("case_id", clean.search_key((F.col("title"), 60), (F.col("question"), 120), (F.col("category"), 10), (F.col("source"), 10)).alias("key"))


@query("FN19_repair_distractors", "SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 'A,B,C' ELSE 'A,B' END AS ids FROM cases_v")
def _(s, d):
    made = F.when(F.col("case_id") % 2 == 0, F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit("y"), F.lit("D"), F.lit("z"))).otherwise(F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit("y")))
    out = clean.repair_distractors(made, F.lit("D"), F.array(F.lit("A"), F.lit("B"), F.lit("C")))
    return views.cases(s, d).select("case_id", F.array_join(F.array_sort(F.map_keys(out)), ",").alias("ids"))


@query("FN20_source_label", "SELECT case_id, CASE source WHEN 'src1' THEN 'First' WHEN 'src2' THEN 'Second' ELSE source END AS label FROM cases_v")
def _(s, d):
    table = s.createDataFrame([("src1", "First"), ("src2", "Second")], "source string, label string")
    return views.cases(s, d).join(F.broadcast(table), "source", "left").select("case_id", F.coalesce("label", "source").alias("label"))  # two rows


@query("FN22_recall", "SELECT case_id, round(CASE WHEN score > 0 THEN greatest(CAST(0.25 AS DOUBLE), least(1, pow(1 + (pow(0.9, -2) - 1) * difficulty * 30 / score, -0.5))) ELSE 0.25 END, 9) AS recall FROM cases_v")
def _(s, d):
    return views.cases(s, d).select("case_id", F.round(scoring.recall_probability(F.col("score"), F.col("difficulty") * 30, F.lit(4)), 9).alias("recall"))


@query("FN23_panel_score", "SELECT case_id, CASE WHEN m > 0 THEN v[1 + case_id % 5] / m ELSE 0 END::DOUBLE AS score FROM (SELECT case_id, v, list_max(v) AS m FROM (SELECT case_id, list_transform([1, 2, 3, 4, 5], lambda k: (case_id * k) % 7) AS v FROM cases_v))")
def _(s, d):
    i = F.col("case_id")
    votes = F.array(*[((i * k) % 7).cast("int") for k in range(1, 6)])
    return views.cases(s, d).select("case_id", scoring.panel_score(votes, (i % 5).cast("int")).cast("double").alias("score"))


@query("FN25_custom_ids", "SELECT case_id, CAST(case_id AS VARCHAR) AS found FROM cases_v")
def _(s, d):
    i = F.col("case_id")
    made = F.when(i % 2 == 0, F.concat(F.lit("needs|few|"), i)).otherwise(F.concat(F.lit("run-"), i))
    return views.cases(s, d).select("case_id", text.parse_custom_id(made).alias("found"))


@query("FN28_units", "SELECT case_id, 'at ' || case_id || ' mg/dL and 3 mmHg' AS t FROM cases_v")
def _(s, d):
    return views.cases(s, d).select("case_id", clean.canonical_units(F.concat(F.lit("at "), "case_id", F.lit(" MG / dl and 3 mm hg"))).alias("t"))


@query("JN04_recover_questions", "SELECT f.case_id, q AS question FROM fp_v f JOIN (SELECT fp, arg_max(question, case_id) AS q FROM fp_v JOIN cases_v USING (case_id) WHERE fp <> '' GROUP BY fp) USING (fp) WHERE f.case_id % 6 = 0", (CASES_SQL, OPTIONS_SQL, "fp_v AS (SELECT case_id, array_to_string(list_sort(list(substring(trim(lower(option_text)), 1, 30))), '|') AS fp FROM options_v GROUP BY case_id)"))
def _(s, d):
    c = views.cases(s, d)
    bank, _o, _raw = raw_rows(s, d)
    raw = c.select("case_id", "question", "pos").join(bank, "case_id")
    lost = c.withColumn("question", F.when(F.col("case_id") % 6 == 0, "").otherwise(F.lit("x")))
    return keys.recover_questions(lost, bank, raw.select("fp", "question", "pos"))


@query("JN11_due_with_cases", "SELECT case_id, category, n FROM (SELECT case_id, count(*) AS n FROM telemetry_v GROUP BY case_id) JOIN cases_v USING (case_id)", (CASES_SQL, TELEMETRY_SQL))
def _(s, d):
    return views.telemetry(s, d).groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).join(views.cases(s, d).select("case_id", "category"), "case_id")


@query("AG10_overview", "SELECT (SELECT count(*) FROM cases_v) AS cases, (SELECT count(*) FROM options_v) AS options, (SELECT count(*) FROM feedback_v) AS reports, (SELECT count(*) FROM telemetry_v) AS answers", (CASES_SQL, OPTIONS_SQL, FEEDBACK_SQL, TELEMETRY_SQL))
def _(s, d):
    c = views.cases(s, d)
    parts = {"cases": c, "options": views.options(c), "reports": views.feedback(s, d), "answers": views.telemetry(s, d)}
    rows = None
    for n, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in parts])


def panels(s, d):
    i = F.col("case_id")
    votes = F.array(*[((i * k) % 7).cast("int") for k in range(1, 6)])
    return views.cases(s, d).select("case_id", votes.alias("votes"), F.when(i % 4 == 0, "").otherwise("h").alias("hypothesis"), "narrative")


PANELS = (CASES_SQL, "panel_v AS (SELECT case_id, v, list_sum(v) AS t, case_id % 4 = 0 AS no_h, narrative FROM (SELECT case_id, narrative, list_transform([1, 2, 3, 4, 5], lambda k: (case_id * k) % 7) AS v FROM cases_v))")


@query("AG13_panel_metrics", "SELECT count(*) AS items, round(avg(t), 4) AS mean_panel, round(avg(list_max(v) / t), 4) AS modal_agreement FROM panel_v WHERE t > 0", PANELS)
def _(s, d):
    return quality.panel_metrics(panels(s, d))


@query(
    "QA18_audit_panel",
    """SELECT case_id, 'P' AS layer, code, severity FROM (SELECT case_id, 'no_votes' AS code, 'critical' AS severity FROM panel_v WHERE t = 0 UNION ALL SELECT case_id, 'small_panel', 'medium' FROM panel_v WHERE t BETWEEN 1 AND 9
    UNION ALL SELECT case_id, 'flat_votes', 'low' FROM panel_v WHERE t > 0 AND list_max(v) = list_min(v) UNION ALL SELECT case_id, 'no_hypothesis', 'high' FROM panel_v WHERE no_h UNION ALL SELECT case_id, 'short_vignette', 'medium' FROM panel_v WHERE length(narrative) < 50)""",
    PANELS,
)
def _(s, d):
    return quality.audit_panel(panels(s, d))


@query("AG15_distractor_conflicts", """SELECT source, count(*) AS n, CAST(sum(CASE WHEN case_id % 7 = 0 AND key IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM (
  SELECT c.case_id, any_value(c.source) AS source, max(option_id) FILTER (is_correct) AS key FROM cases_v c LEFT JOIN options_v o ON o.case_id = c.case_id GROUP BY c.case_id) GROUP BY ROLLUP (source)""", BOTH)
def _(s, d):
    """Maps of the options' texts without the key's; every seventh case has the key's too."""
    c = cased(s, d)
    key = F.get(F.filter("options", lambda o: o["is_correct"]), F.lit(0))["id"]
    listed = F.filter("options", lambda o: ~o["is_correct"] | (F.col("case_id") % 7 == 0))
    texts = F.map_from_arrays(F.transform(listed, lambda o: o["id"]), F.transform(listed, lambda o: o["text"]))
    return quality.distractor_conflicts(c.select("case_id", "source", key.alias("key"), texts.alias("distractors")))


@query("AG13_panel_sizes", """SELECT t AS panel, count(*) AS items, count(*) FILTER (t > 0 AND 2 * m > t) AS majority, round(avg(l), 4) AS mean_vignette FROM (SELECT CAST(list_sum(v) AS INTEGER) AS t, list_max(v) AS m, l FROM (
  SELECT list_transform([1, 2, 3, 4, 5], lambda k: (case_id * k * k) % 7) AS v, length(narrative) AS l FROM cases_v)) GROUP BY t""")
def _(s, d):
    votes = F.array(*[((F.col("case_id") * k * k) % 7).cast("int") for k in range(1, 6)])
    return quality.panel_sizes(views.cases(s, d).select("case_id", votes.alias("votes"), "narrative"))


@query("EN11_severity", """SELECT c.case_id, quarantined OR coalesce(v = 'FATAL', false) AS quarantined, v AS verdict, w AS reasoning, CASE WHEN v = 'FATAL' THEN nullif(a, '') END AS suggested_answer FROM cases_v c LEFT JOIN (
  SELECT conv_id, arg_max(CASE turn % 3 WHEN 0 THEN 'MINOR' WHEN 1 THEN 'FATAL' ELSE '' END, turn) AS v, arg_max(coalesce(text, ''), turn) AS w, arg_max(CASE WHEN turn % 2 = 1 THEN chr(CAST(65 + conv_id % 4 AS INTEGER)) ELSE '' END, turn) AS a FROM conversations GROUP BY conv_id) t ON t.conv_id = c.case_id""")
def _(s, d):
    """Turns as verdicts of a severity audit; the last turn of a case stands."""
    t = F.col("turn")
    letter = F.when(t % 2 == 1, F.expr("char(65 + conv_id % 4)")).otherwise("")
    found = views.table(s, d, "conversations").select(F.col("conv_id").alias("case_id"), t.alias("pos"), F.when(t % 3 == 0, "minor").when(t % 3 == 1, "Fatal").alias("severity"), F.col("text").alias("reasoning"), letter.alias("answer"))
    return quality.apply_severity(views.cases(s, d).select("case_id", "quarantined"), found)


@query("AG21_manifest_stats", "SELECT status AS code, count(*) AS n FROM cases_v WHERE status <> 'OK' GROUP BY status")
def _(s, d):
    return views.cases(s, d).where("status <> 'OK'").groupBy(F.col("status").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("AG23_dataset_stats", "SELECT count(*) AS total, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (length(rationale) >= 100) AS explained, count(*) FILTER (score >= 80) AS verified, count(DISTINCT source) AS sources, count(DISTINCT category) AS categories FROM cases_v")
def _(s, d):
    return quality.dataset_stats(views.cases(s, d))


READ = {"html": 5, "symbols": 3, "long_sentence": 2}
MARKS = {
    "html": "regexp_matches(question, '<[a-z/][^>]*>')", "broken_lines": "regexp_matches(question, '[a-z]\\n[a-z]')", "symbols": "regexp_matches(question, '[#*%$&]{3,}')",
    "long_sentence": "len(list_filter(regexp_split_to_array(question, '[.?!]'), lambda x: length(x) > 400)) > 0", "no_space_after_stop": "regexp_matches(question, '[a-z]\\.[A-Z]')", "shouting": "regexp_matches(question, '([A-Z]{4,} ){4,}')",
}
QUEUE_SQL = (
    "queue_v AS (SELECT case_id, source, list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in MARKS.items()) + "], lambda x: x IS NOT NULL) AS reasons FROM cases_v)"
)


@query("QA16_readability", "SELECT case_id, source, array_to_string(reasons, ',') AS reasons, CAST(list_sum(list_transform(reasons, lambda r: CASE r WHEN 'html' THEN 5 WHEN 'symbols' THEN 3 WHEN 'long_sentence' THEN 2 ELSE 1 END)) AS BIGINT) AS priority FROM queue_v WHERE len(reasons) > 0", (CASES_SQL, QUEUE_SQL))
def _(s, d):
    return quality.readability_queue(views.cases(s, d), READ).withColumns({"reasons": F.array_join("reasons", ","), "priority": F.col("priority").cast("long")})


@query("SC11_lane", "SELECT case_id, CASE WHEN list_contains(reasons, 'html') OR list_contains(reasons, 'symbols') THEN 'source_text' WHEN list_contains(reasons, 'broken_lines') OR list_contains(reasons, 'no_space_after_stop') THEN 'auto' WHEN list_contains(reasons, 'shouting') THEN 'editor' ELSE 'advisory' END AS lane FROM queue_v WHERE len(reasons) > 0", (CASES_SQL, QUEUE_SQL))
def _(s, d):
    return quality.lane(quality.readability_queue(views.cases(s, d), READ)).select("case_id", "lane")


@query("AG17_queue_summary", "SELECT 'reason' AS dimension, value, count(*) AS n FROM (SELECT unnest(reasons) AS value FROM queue_v) GROUP BY value UNION ALL SELECT 'source', source, count(*) FROM queue_v WHERE len(reasons) > 0 GROUP BY source", (CASES_SQL, QUEUE_SQL))
def _(s, d):
    return quality.queue_summary(quality.readability_queue(views.cases(s, d), READ))


@query("AG17_actions", """SELECT action, count(*) AS n, CAST(sum(len(reasons)) AS BIGINT) AS priority, count(DISTINCT source) AS sources FROM (SELECT *, CASE WHEN list_contains(reasons, 'html') OR list_contains(reasons, 'symbols') THEN 'source_text' WHEN list_contains(reasons, 'broken_lines') OR list_contains(reasons, 'no_space_after_stop') THEN 'auto'
  WHEN list_contains(reasons, 'shouting') THEN 'editor' ELSE 'advisory' END AS action FROM queue_v WHERE len(reasons) > 0) GROUP BY action ORDER BY n DESC, action LIMIT 15""", (CASES_SQL, QUEUE_SQL))
def _(s, d):
    return quality.action_summary(quality.readability_queue(views.cases(s, d), {}))


@query("TK02_queue_order", "SELECT case_id, priority FROM (SELECT case_id, CAST(len(reasons) AS BIGINT) AS priority FROM queue_v WHERE len(reasons) > 0)", (CASES_SQL, QUEUE_SQL))
def _(s, d):
    return audit.queue_order(quality.readability_queue(views.cases(s, d), {})).select("case_id", F.col("priority").cast("long").alias("priority"))


@query("TK08_open_proposals", "SELECT id FROM feedback_v WHERE status IN ('open', 'resolved') ORDER BY created_at DESC, id DESC LIMIT 30", (FEEDBACK_SQL,))
def _(s, d):
    return report.page(views.feedback(s, d).where(F.col("status").isin("open", "resolved")), 30).select("id")


@query("FL06_purge", "SELECT case_id FROM cases_v WHERE status NOT IN ('QUARANTINED_TOXIC')")
def _(s, d):
    return views.cases(s, d).where(~F.col("status").isin("QUARANTINED_TOXIC")).select("case_id")


@query("FL11_pending", "SELECT case_id FROM cases_v WHERE source = 'src3' AND NOT (quarantined OR starts_with(status, 'QUARANTINED')) AND score < 90")
def _(s, d):
    return views.cases(s, d).where((F.col("source") == "src3") & ~report.is_quarantined() & (F.col("score") < 90)).select("case_id")


Q_CHECKS = [
    ("no_options", "critical", "n_options = 0"), ("no_correct", "critical", "n_options > 0 AND n_right = 0"), ("multi_correct", "high", "n_right > 1"), ("truncated_question", "medium", "regexp_matches(trim(question), '[,;:(-]$')"),
    ("truncated_option", "low", "case_id IN (SELECT case_id FROM options_v WHERE regexp_matches(trim(option_text), '[,;(-]$'))"), ("placeholder_rationale", "medium", "trim(rationale) = ''"),
    ("above_option", "low", "case_id IN (SELECT case_id FROM options_v WHERE regexp_matches(lower(option_text), '^(all|none) of the above'))"), ("duplicate_options", "high", "n_distinct < n_options"),
]


@query("QA05_quality_audit", union(Q_CHECKS, "Q"), AUDIT)
def _(s, d):
    return quality.quality_audit(cased(s, d))


LOCAL = [("L1", "the", "of", "zzz"), ("L2", "und", "die", "der")]


@query("QA04_localization", union([(c, "medium", f"regexp_matches(x, '{k}') AND regexp_matches(x, '{a}') AND NOT regexp_matches(x, '{b}')") for c, k, a, b in LOCAL], "D").replace("FROM agg_v", "FROM (SELECT a.case_id, lower(question || ' ' || coalesce(o, '')) AS x FROM agg_v a LEFT JOIN (SELECT case_id, string_agg(option_text, ' ' ORDER BY slot) AS o FROM options_v GROUP BY case_id) USING (case_id))"), AUDIT)
def _(s, d):
    return quality.audit_localization(cased(s, d), LOCAL)


def said(s, d):
    """Cases whose rationale names an answer letter."""
    i = F.col("case_id")
    named = F.substring(F.lit("ABCD"), (i % 3 + 1).cast("int"), F.lit(1))
    return cased(s, d).withColumn("rationale", F.when(i % 2 == 0, F.concat(F.lit("The correct answer is "), named, F.lit(". "), F.col("rationale"))).otherwise(F.lit("none")))


@query("QA08_rationale_answer", "SELECT case_id, substring('ABCD', CAST(1 + case_id % 3 AS INTEGER), 1) AS named, CAST(22 AS BIGINT) AS at FROM cases_v WHERE case_id % 2 = 0")
def _(s, d):
    return rationale.rationale_answers(said(s, d)).select("case_id", "named", "at")


@query("QA11_fix_keys", "SELECT case_id, CASE WHEN n_right > 0 THEN substring('ABCD', CAST(1 + case_id % 4 AS INTEGER), 1) END AS key, substring('ABCD', CAST(1 + case_id % 3 AS INTEGER), 1) AS named, 'flip' AS action FROM agg_v WHERE case_id % 2 = 0 AND case_id IN (SELECT case_id FROM options_v o WHERE o.slot = 1 + o.case_id % 3) AND (n_right = 0 OR case_id % 4 <> case_id % 3)", AUDIT)
def _(s, d):
    c = said(s, d)
    return quality.fix_keys(c, rationale.rationale_answers(c))


@query("QA13_dissonance", f"""SELECT case_id FROM (SELECT a.case_id, {NORM.format('c.rationale')} AS r, unnest(list_distinct(list_filter(string_split({NORM.format('answer')}, ' '), lambda w: length(w) >= 5))) AS t FROM ({ANSWERS}) a JOIN cases_v c ON c.case_id = a.case_id)
  WHERE r <> '' GROUP BY case_id HAVING NOT bool_or(contains(r, t) OR (t = 'heart' AND contains(r, 'cardiac')))""", BOTH)
def _(s, d):
    c = views.cases(s, d)
    return rationale.dissonance(c, answers(s, d), s.createDataFrame([("heart", "cardiac")], "token string, variant string"))


@query("QA14_wrong_explained", f"""SELECT case_id, right_hits, wrong_hits FROM (SELECT case_id, coalesce(max(n) FILTER (is_correct), 0) AS right_hits, coalesce(max(n) FILTER (NOT is_correct), 0) AS wrong_hits FROM (
    SELECT o.case_id, is_correct, len(list_filter(string_split({NORM.format('c.rationale')}, ' '), lambda w: length(w) >= 5 AND list_contains(string_split({NORM.format('option_text')}, ' '), w))) AS n FROM options_v o JOIN cases_v c ON c.case_id = o.case_id WHERE length(c.rationale) > 0) GROUP BY case_id) WHERE wrong_hits > right_hits""", BOTH)
def _(s, d):
    return rationale.wrong_explained(cased(s, d))


V_CHECKS = [
    ("image_phrase", "medium", "regexp_matches(lower(question), '\\b(shown (below|above)|in the (image|figure|picture)|gambar)\\b')"), ("ocr_token", "low", "regexp_matches(lower(question), '\\b[a-z]*[0-9][a-z]+[0-9][a-z]*\\b')"),
    ("duplicate_option", "high", "n_lower < n_options"), ("single_letters", "high", "case_id IN (SELECT case_id FROM options_v WHERE regexp_matches(trim(option_text), '^[A-Za-z]$'))"), ("rough_rationale", "low", "length(trim(rationale)) BETWEEN 1 AND 30"),
]


@query("QA20_salvage", union(V_CHECKS, "V"), AUDIT)
def _(s, d):
    return quality.salvage_queue(cased(s, d))


@query("QA21_smoke", "SELECT 'few_options' AS name, count(*) FILTER (n_options < 2) AS n, count(*) FILTER (n_options < 2) * 20 <= count(*) AS passed FROM agg_v UNION ALL SELECT 'no_key', count(*) FILTER (n_right = 0), count(*) FILTER (n_right = 0) * 20 <= count(*) FROM agg_v UNION ALL SELECT 'no_rationale', count(*) FILTER (length(rationale) = 0), count(*) FILTER (length(rationale) = 0) * 20 <= count(*) FROM agg_v UNION ALL SELECT 'repeated_ids', 0, true", AUDIT)
def _(s, d):
    return quality.smoke(cased(s, d))


@query("EN01_split_wall", "SELECT case_id, 'A,B' AS letters FROM cases_v WHERE length(trim(substring(title, 1, 20))) >= 10 AND length(trim(substring(narrative, 40, 30))) >= 10 AND position('(' IN question) = 0")
def _(s, d):
    c = views.cases(s, d)
    a, b = F.substring("title", 1, 20), F.substring("narrative", 40, 30)
    kept = c.where((F.length(F.trim(a)) >= 10) & (F.length(F.trim(b)) >= 10) & ~F.col("question").contains("("))
    wall = F.concat(F.lit("(A) "), a, F.lit(" (B) "), b)
    return kept.select("case_id", F.array_join(F.array_sort(F.map_keys(rationale.split_wall(wall))), ",").alias("letters"))


@query("EN02_inject_pearl", "SELECT case_id, CASE WHEN regexp_matches(lower(question), ' the ') THEN 'English' WHEN regexp_matches(lower(question), ' und ') THEN 'German' ELSE 'x' END AS pearl FROM cases_v")
def _(s, d):
    return views.cases(s, d).select("case_id", rationale.inject_pearl(F.col("question"), F.lit("x"), {" the ": "English", " und ": "German"}).alias("pearl"))


@query("EN03_enrich_queue", "SELECT case_id FROM agg_v WHERE n_right > 0 AND case_id % 5 = 0", AUDIT)
def _(s, d):
    return rationale.enrich_queue(cased(s, d).withColumn("rationale", F.when(F.col("case_id") % 5 == 0, "N/A").otherwise("a real explanation"))).select("case_id")


@query("EN05_purge_placeholders", "SELECT case_id, CASE WHEN case_id % 5 = 0 THEN greatest(score - 10, 0) ELSE score END AS score FROM cases_v")
def _(s, d):
    c = views.cases(s, d).withColumn("rationale", F.when(F.col("case_id") % 5 == 0, "None").otherwise("a real explanation"))
    return rationale.purge_placeholders(c).select("case_id", "score")


@query("EN10_triage", "SELECT case_id FROM cases_v WHERE status <> 'OK' AND NOT (case_id % 3 = 0 OR (case_id % 3 = 1 AND case_id % 2 = 0))")
def _(s, d):
    i = F.col("case_id")
    c = views.cases(s, d)
    verdicts = c.select("case_id", F.when(i % 3 == 0, "UNQUARANTINE").when(i % 3 == 1, "FIX").otherwise("KEEP").alias("verdict"), F.when(i % 2 == 0, "HIGH").otherwise("LOW").alias("confidence"), F.lit("A").alias("new_key"))
    return quality.apply_triage(c.where("status <> 'OK'").select("case_id"), verdicts)[0]


@query("EN11_translation", "SELECT case_id, option_id, CASE WHEN case_id % 4 = 0 AND option_id = 'A' THEN 'translated' ELSE option_text END AS option_text FROM options_v", BOTH)
def _(s, d):
    o = views.options(views.cases(s, d))
    done = o.where("case_id % 4 = 0 and option_id = 'A'").select("case_id", "option_id", F.lit("translated").alias("text"))
    return quality.apply_translation(o, done).select("case_id", "option_id", "option_text")


@query("EN14_auto_fix", "SELECT case_id, CASE WHEN trim(title) = '' THEN substring(trim(question), 1, 60) ELSE title END AS title, regexp_replace(question, '(\\*\\*|__|`)', '', 'g') AS question, exam_type FROM cases_v")
def _(s, d):
    return quality.auto_fix(views.cases(s, d)).select("case_id", "title", "question", "exam_type")


@query("UD01_remediate", "SELECT case_id, CASE WHEN truncated THEN upper(category) ELSE category END AS category FROM cases_v")
def _(s, d):
    c = views.cases(s, d).select("case_id", "category", "truncated")
    return quality.remediate(c, F.col("truncated"), lambda df: df.withColumn("category", F.upper("category"))).select("case_id", "category")


@query("SC09_issue_type", "SELECT case_id, CASE WHEN needs_review AND case_id % 2 = 0 THEN 'answer' WHEN needs_review THEN 'text' WHEN n_options < 2 THEN 'few_options' WHEN n_right = 0 THEN 'no_key' WHEN truncated THEN 'truncated' ELSE 'other' END AS type FROM agg_v", AUDIT)
def _(s, d):
    c = cased(s, d)
    kinds = F.explode(F.when(F.col("case_id") % 2 == 0, F.array(F.lit("text"), F.lit("answer"))).otherwise(F.array(F.lit("text")))).alias("type")
    return quality.issue_type(c, c.where("needs_review").select("case_id", kinds), ["answer", "text"])


@query("SC13_modes", "SELECT a.case_id, length(question) < 120 AS rapid, coalesce(length(r) > 1.5 * m, false) AS length_bias FROM agg_v a LEFT JOIN (SELECT case_id, min(option_text) FILTER (is_correct) AS r, max(length(option_text)) FILTER (NOT is_correct) AS m FROM options_v GROUP BY case_id) USING (case_id)", AUDIT)
def _(s, d):
    return quality.tag_modes(cased(s, d))


@query("WN05_best_finding", "SELECT case_id, level, code FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY w DESC, pos) AS rn FROM (SELECT conv_id AS case_id, turn AS pos, CASE turn % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS level, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS w, 'c' || turn AS code FROM conversations)) WHERE rn = 1".replace("FROM conversations", "FROM turns_v"), ("turns_v AS (SELECT conv_id, turn FROM conversations)",))
def _(s, d):
    t = F.col("turn")
    rows = views.table(s, d, "conversations").select(F.col("conv_id").alias("case_id"), t.alias("pos"), F.when(t % 3 == 0, "low").when(t % 3 == 1, "high").otherwise("medium").alias("level"), F.concat(F.lit("c"), t).alias("code"))
    return report.best_finding(rows, {"high": 3, "medium": 2, "low": 1})


@query("WN04_first_seen", f"SELECT case_id, min(case_id) OVER (PARTITION BY k) AS first_id FROM (SELECT case_id, substring({ALNUM.format('question')}, 1, 60) AS k FROM cases_v) WHERE length(k) >= 20")
def _(s, d):
    from ..operators import dedup

    return dedup.first_of_key(views.cases(s, d), F.substring(text.alnum("question"), 1, 60), 20)


@query("PR01_map_mcq", "SELECT case_id AS case_key, n_options AS n, n_right AS n_right FROM agg_v", AUDIT)
def _(s, d):
    c = cased(s, d)
    texts = F.map_from_entries(F.transform("options", lambda o: F.struct(o["id"], o["text"])))
    letter = F.substring(F.lit("ABCD"), (F.col("case_id") % 4 + 1).cast("int"), F.lit(1))
    raw = c.select(F.col("case_id").alias("case_key"), "question", texts.alias("options"), letter.alias("answer_idx"), F.lit(None).cast("string").alias("answer"))
    return parse.parse_map_mcq(raw).select("case_key", F.size("options").cast("long").alias("n"), F.size(F.filter("options", lambda o: o["is_correct"])).cast("long").alias("n_right"))


@query("PR05_choices", "SELECT case_id AS case_key, n_options AS n, n_right FROM agg_v", AUDIT)
def _(s, d):
    parts = F.slice(F.split("question", "\\.", -1), 1, 4)
    raw = views.cases(s, d).select(F.col("case_id").alias("case_key"), "question", parts.alias("choices"), (F.col("case_id") % 4).alias("answer"))
    return parse.parse_choices(raw).select("case_key", F.size("options").cast("long").alias("n"), F.size(F.filter("options", lambda o: o["is_correct"])).cast("long").alias("n_right"))


@query("PR09_union_sources", "SELECT case_key, count(*) AS n FROM (SELECT case_id AS case_key FROM cases_v UNION ALL SELECT case_id FROM cases_v WHERE case_id % 2 = 0) GROUP BY case_key")
def _(s, d):
    c = views.cases(s, d)
    ynm = parse.parse_ynm(c.where("case_id % 2 = 0").select(F.col("case_id").alias("case_key"), "question", F.array("title").alias("contexts"), F.lit("yes").alias("final_decision")))
    lists = parse.parse_list_mcq(c.select(F.col("case_id").alias("case_key"), "question", F.array("title").alias("answers"), F.lit(1).alias("ra")))
    return parse.union_sources(ynm, lists).groupBy("case_key").agg(F.count(F.lit(1)).alias("n"))


@query("PR12_align_anchor", "SELECT case_id, CASE WHEN n_options > 1 THEN 1 ELSE n_right END AS n_right FROM (SELECT case_id, n_options, n_right FROM agg_v WHERE n_options > 1)", AUDIT)
def _(s, d):
    c = cased(s, d).where(F.size("options") > 1).withColumn("anchor", F.element_at("options", 2)["text"])
    return parse.align_anchor(c).select("case_id", F.size(F.filter("options", lambda o: o["is_correct"])).cast("long").alias("n_right"))


@query("IO03_unwrap_rows", "SELECT case_id FROM cases_v")
def _(s, d):
    c = views.cases(s, d).select("case_id", "title")
    i = F.col("case_id")
    rows = c.select(F.when(i % 3 == 0, F.struct("case_id", "title")).alias("row"), F.when(i % 3 == 1, F.array(F.struct("case_id", "title"))).alias("rows"), F.when(i % 3 == 2, i).alias("case_id"), F.when(i % 3 == 2, F.col("title")).alias("title"))
    return io.unwrap_rows(rows, ["case_id", "title"]).select("case_id")


@query("DD08_canonical", f"""SELECT canonical_id, n FROM (SELECT arg_max(case_id, row(score, length(rationale), length(question), -case_id)) AS canonical_id, count(*) AS n, count(DISTINCT source) AS k FROM cases_v WHERE length(question) > 0 GROUP BY substring({NORM.format('question')}, 1, 200)) WHERE n >= 2 AND k >= 2""")
def _(s, d):
    from ..operators import dedup

    return dedup.cross_source_dedup(views.cases(s, d), answers(s, d)).where("case_id = canonical_id").select("canonical_id", "n")


@query("SE05_row_difference", "SELECT case_id FROM cases_v WHERE case_id % 10 = 0")
def _(s, d):
    a = views.cases(s, d)
    b = a.withColumn("title", F.when(F.col("case_id") % 10 == 0, "changed").otherwise(F.col("title")))
    return a.select("case_id", "title").withColumn("title", F.coalesce(F.nullif("title", F.lit("changed")), F.lit("was"))).exceptAll(b.select("case_id", "title")).select("case_id")


@query("SE07_token_overlap", f"SELECT case_id, len(list_intersect(list_distinct(string_split({NORM.format('question')}, ' ')), list_distinct(string_split({NORM.format('rationale')}, ' ')))) AS shared FROM cases_v")
def _(s, d):
    tokens = lambda c: F.array_distinct(F.split(text.comparable(c), " "))
    return views.cases(s, d).select("case_id", F.size(F.array_intersect(tokens("question"), tokens("rationale"))).cast("long").alias("shared"))


@query("WN06_runner_up", "SELECT source, max(category) FILTER (rn = 1) AS winner, max(category) FILTER (rn = 2) AS runner_up FROM (SELECT source, category, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, category) AS rn FROM cases_v GROUP BY source, category) GROUP BY source")
def _(s, d):
    ranked = views.cases(s, d).groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category")))
    return ranked.groupBy("source").agg(best.alias("b")).select("source", F.get("b", F.lit(0))["category"].alias("winner"), F.get("b", F.lit(1))["category"].alias("runner_up"))


FP_SQL = "fp_v AS (SELECT case_id, array_to_string(list_sort(list(substring(trim(lower(option_text)), 1, 30))), '|') AS fp FROM options_v GROUP BY case_id)"
FPS = (CASES_SQL, OPTIONS_SQL, FP_SQL)


@query(
    "JN05_keys_by_prefix",
    f"""SELECT c.case_id, coalesce(h.a, p.a) AS answer FROM (SELECT case_id, substring({NORM.format('question')}, 1, 60) AS head FROM cases_v) c LEFT JOIN fp_v USING (case_id)
    LEFT JOIN (SELECT substring({NORM.format('question')}, 1, 60) AS head, arg_min(title, pos) AS a FROM cases_v WHERE case_id % 2 = 0 AND case_id IN (SELECT case_id FROM fp_v) GROUP BY 1) h USING (head)
    LEFT JOIN (SELECT fp, arg_min(title, pos) AS a FROM cases_v JOIN fp_v USING (case_id) WHERE case_id % 2 = 0 AND fp <> '' GROUP BY fp) p USING (fp) WHERE coalesce(h.a, p.a) IS NOT NULL""",
    FPS,
)
def _(s, d):
    c = views.cases(s, d)
    bank = keys.fingerprints(views.options(c))
    raw = c.where("case_id % 2 = 0").join(bank, "case_id").select("question", "fp", F.col("title").alias("answer"), "pos")
    return keys.recover_keys_by_prefix(c, bank, raw)


@query(
    "JN14_refill_stem",
    """SELECT f.case_id, coalesce(e.q, l.q) AS question FROM (SELECT case_id, case_id % 3 AS year, fp FROM fp_v) f LEFT JOIN (SELECT case_id % 3 AS year, fp, arg_max(question, case_id) AS q FROM fp_v JOIN cases_v USING (case_id) WHERE case_id % 2 = 0 GROUP BY 1, 2) e USING (year, fp)
    LEFT JOIN (SELECT fp, arg_max(question, case_id) AS q FROM fp_v JOIN cases_v USING (case_id) WHERE case_id % 2 = 0 GROUP BY fp) l USING (fp) WHERE coalesce(e.q, l.q) IS NOT NULL""",
    FPS,
)
def _(s, d):
    c = views.cases(s, d)
    bank = keys.fingerprints(views.options(c)).withColumn("year", F.col("case_id") % 3)
    raw = c.where("case_id % 2 = 0").select("case_id", "question", "pos").join(bank, "case_id").select("year", "fp", "question", "pos")
    return keys.refill_stem(bank, raw)


@query("WN11_cap_groups", "SELECT case_id, source FROM cases_v WHERE source IN (SELECT source FROM cases_v GROUP BY source ORDER BY min(pos), source LIMIT 5)")
def _(s, d):
    return report.cap_groups(views.cases(s, d), "source", 5).select("case_id", "source")


X_CHECKS = [
    ("answer_lead", "low", "regexp_matches(lower(rationale), '^\\s*(ans|answer|jawaban)\\s*[:.-]')"), ("reference", "low", "regexp_matches(lower(rationale), 'ref(erence)?s?\\s*[:.-]')"),
    ("page_mark", "low", "regexp_matches(lower(rationale), 'pg\\.?\\s*(no\\.?)?\\s*[0-9]+')"), ("image_mark", "low", "regexp_matches(lower(rationale), '\\[(image|figure|img)')"),
    ("markup", "medium", "regexp_matches(rationale, '</?[a-z]+[^>]*>')"), ("odd_symbols", "low", "regexp_matches(rationale, '[#*%$&]{3,}')"), ("mojibake", "medium", "regexp_matches(rationale, '[ÂÃ][^ ]')"),
    ("no_title", "low", "trim(title) = ''"), ("no_narrative", "low", "trim(narrative) = ''"), ("no_confidence", "low", "confidence IS NULL"),
]


@query("QA17_deep_audit", union(X_CHECKS, "X").replace("agg_v", "cases_v"))
def _(s, d):
    return quality.deep_audit(views.cases(s, d))


@query("SC12_category_pack", "SELECT case_id, bucket, array_to_string([category, 'X'], ',') AS allowed FROM (SELECT case_id, category, 'low' AS bucket FROM cases_v WHERE score < 30 UNION ALL SELECT case_id, category, 'even' FROM cases_v WHERE case_id % 2 = 0)")
def _(s, d):
    made = views.cases(s, d).select("case_id", "score", F.col("category").alias("raw"), F.lit("X").alias("resolved"), F.lit(None).cast("string").alias("runner_up"))
    return quality.category_pack(made, {"low": "score < 30", "even": "case_id % 2 = 0"}).withColumn("allowed", F.array_join("allowed", ","))
