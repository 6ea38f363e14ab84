"""Queries of the library over the derived views, each with the SQL of its rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, signature, text
from ..operators import audit, category, contradictions, dedup, gates, ids, keys, memory, merge, report, review
from ..sources import io, parse
from . import views
from .views import CASES_SQL, FEEDBACK_SQL, OPTIONS_SQL, TELEMETRY_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = (CASES_SQL,)):
    """Register a query; ``needs`` are the views its SQL reads."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {', '.join(needs)} {sql}"
        return f

    return put


BOTH = (CASES_SQL, OPTIONS_SQL)
# DuckDB forms of the text functions.
NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
ALNUM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


def with_label(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the cases that have a label."""
    return views.table(spark, d, "labels").select(F.col("doc_id").alias("case_id")).where("case_id is not null").distinct()


def answers(spark: SparkSession, d: str) -> DataFrame:
    return views.options(views.cases(spark, d)).where("is_correct").select("case_id", F.col("option_text").alias("answer"))


ANSWERS = "SELECT case_id, option_text AS answer FROM options_v WHERE is_correct"

DEDUP_SQL = f"""SELECT n.case_id, n.fp, g.n, g.n_sources,
  CASE WHEN g.kind = 'conflict' THEN 'conflict' WHEN n.case_id = g.canonical_id THEN 'canonical' ELSE 'duplicate' END AS state, g.canonical_id
FROM narrow n JOIN (SELECT fp, count(*) AS n, count(DISTINCT source) AS n_sources,
    CASE WHEN count(answer) = count(*) AND min(answer) = max(answer) THEN 'duplicate' ELSE 'conflict' END AS kind,
    arg_max(case_id, row(score, rl, ql, -case_id)) AS canonical_id
  FROM narrow LEFT JOIN one USING (case_id) GROUP BY fp HAVING count(*) >= 2 AND count(DISTINCT source) >= 2) g USING (fp)"""
NARROW = f"""narrow AS (SELECT case_id, source, score, length(rationale) AS rl, length(question) AS ql,
  substring(sha256(substring({NORM.format('question')}, 1, 200)), 1, 12) AS fp FROM cases_v WHERE length(question) > 0),
  one AS (SELECT case_id, CASE WHEN count(*) = 1 THEN min({NORM.format('answer')}) END AS answer FROM ({ANSWERS}) GROUP BY case_id)"""


@query("DD07_cross_source_dedup", DEDUP_SQL, (*BOTH, NARROW))
def _(s, d):
    return dedup.cross_source_dedup(views.cases(s, d), answers(s, d))


@query(
    "DD09_prefix_duplicates",
    f"""SELECT substring({NORM.format('question')}, 1, 80) AS prefix, count(DISTINCT case_id) AS n_cases, count(DISTINCT source) AS n_sources, min(case_id) AS first_id
    FROM cases_v WHERE length(substring({NORM.format('question')}, 1, 80)) >= 25 GROUP BY 1 HAVING count(DISTINCT case_id) >= 2 AND count(DISTINCT source) >= 2""",
)
def _(s, d):
    return dedup.prefix_duplicates(views.cases(s, d))


@query(
    "DD10_keep_best",
    f"""SELECT group_id, case_id, first_value(case_id) OVER w AS best_id, case_id = first_value(case_id) OVER w AS kept FROM (
      SELECT substring(lower(question), 1, 80) AS group_id, case_id, NOT quarantined AS free, CASE WHEN length(rationale) >= 150 THEN 2 WHEN length(rationale) >= 50 THEN 1 ELSE 0 END AS tier,
      coalesce(confidence, 0) AS c, length(narrative) AS n FROM cases_v) WINDOW w AS (PARTITION BY group_id ORDER BY free DESC, tier DESC, c DESC, n DESC, case_id)""",
)
def _(s, d):
    c = views.cases(s, d)
    return dedup.keep_best(c, c.select(F.substring(F.lower("question"), 1, 80).alias("group_id"), "case_id"))


@query(
    "DD11_drop_prefix_dups",
    f"""SELECT case_id, source FROM (SELECT *, substring({ALNUM.format('question')}, 1, 100) AS k, row_number() OVER (PARTITION BY substring({ALNUM.format('question')}, 1, 100) ORDER BY pos) AS rn FROM cases_v)
    WHERE rn = 1 OR length(k) < 20""",
)
def _(s, d):
    return dedup.drop_prefix_dups(views.cases(s, d)).select("case_id", "source")


@query(
    "DD12_near_dups",
    "SELECT substring(lower(question), 1, 80) AS prefix, count(*) AS n, min(case_id) AS first_id, max(case_id) AS last_id FROM cases_v WHERE length(question) >= 30 GROUP BY 1 HAVING count(*) >= 2",
)
def _(s, d):
    return dedup.near_dups(views.cases(s, d))


@query(
    "DD13_duplicate_narratives",
    f"""SELECT case_id, first_id FROM (SELECT case_id, min(case_id) OVER (PARTITION BY k) AS first_id, k FROM (SELECT case_id, substring({ALNUM.format('narrative')}, 1, 150) AS k FROM cases_v))
    WHERE length(k) >= 51 AND case_id <> first_id""",
)
def _(s, d):
    return dedup.duplicate_narratives(views.cases(s, d))


SIG = """sig_v AS (
  SELECT case_id, source, exam_type, confidence, rationale, CASE WHEN length(question) >= 30 AND len(top) >= 4 THEN array_to_string(list_sort(top), '_') END AS sig FROM (
    SELECT *, list_transform(list_sort(list_transform(range(1, len(w) + 1), lambda i: {'n': -length(w[i]), 'i': i, 'w': w[i]}))[1:8], lambda x: x.w) AS top FROM (
      SELECT *, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS w FROM (
        SELECT *, list_filter(string_split(trim(regexp_replace(lower(question), '[^a-z]+', ' ', 'g')), ' '), lambda x: length(x) > 4 AND x NOT IN (STOPS)) AS ws FROM cases_v))))""".replace(
    "STOPS", ", ".join(f"'{w}'" for w in signature.STOP_WORDS)
)


@query("DD01_semantic_sig", "SELECT case_id, sig FROM sig_v", (CASES_SQL, SIG))
def _(s, d):
    return views.cases(s, d).select("case_id", signature.semantic_sig(F.col("question")).alias("sig"))


@query(
    "DD02_options_hash",
    f"""SELECT case_id, array_to_string(list_sort(list(k) FILTER (length(k) > 3)), '_') AS oh FROM (SELECT case_id, substring({ALNUM.format('option_text')}, 1, 30) AS k FROM options_v) GROUP BY case_id HAVING count(*) FILTER (length(k) > 3) > 0""",
    BOTH,
)
def _(s, d):
    out = views.cases_with_options(s, d).select("case_id", signature.options_hash(F.transform("options", lambda o: o["text"])).alias("oh"))
    return out.where("oh <> ''")


@query(
    "DD14_signature_groups",
    f"""SELECT sig, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT nullif(answer, '')) AS n_answers, min(case_id) AS first_id,
      CASE WHEN count(DISTINCT nullif(answer, '')) > 1 AND count(DISTINCT source) > 1 THEN 'conflict' ELSE 'duplicate' END AS kind
    FROM sig_v LEFT JOIN (SELECT case_id, min(array_to_string(string_split({NORM.format('answer')}, ' ')[1:3], ' ')) AS answer FROM ({ANSWERS}) GROUP BY case_id) a USING (case_id)
    WHERE sig IS NOT NULL GROUP BY sig HAVING count(*) >= 2""",
    (*BOTH, SIG),
)
def _(s, d):
    return dedup.signature_groups(views.cases(s, d), answers(s, d))


@query(
    "DD15_contradiction_keys",
    f"""SELECT case_id, array_to_string([w[a], w[b], w[c], w[e]], '_') AS key FROM (
      SELECT case_id, list_sort(list_transform(list_sort(list_transform(range(1, len(t) + 1), lambda i: {{'n': -length(t[i]), 'i': i, 'w': t[i]}}))[1:5], lambda x: x.w)) AS w FROM (
        SELECT case_id, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS t FROM (
          SELECT case_id, list_filter(string_split({NORM.format('question')}, ' '), lambda x: length(x) > 3) AS ws FROM cases_v))) q,
      (VALUES (1,2,3,4), (1,2,3,5), (1,2,4,5), (1,3,4,5), (2,3,4,5)) p(a, b, c, e) WHERE len(w) = 5""",
)
def _(s, d):
    return contradictions.contradiction_keys(views.cases(s, d)).select("case_id", "key")


@query("DD18_answer_clusters")
def _(s, d):
    c = views.cases(s, d)
    comps = contradictions.connected(contradictions.contradiction_edges(contradictions.contradiction_keys(c)))
    return contradictions.answer_clusters(comps.join(c.select("case_id", "pos"), "case_id").join(answers(s, d), "case_id"))


# Stock phrases of explanations, in SQL.
HOLLOW = "coalesce(length({0}) < 20 OR " + " OR ".join(f"contains(lower(trim({{0}})), '{p}')" for p in merge.PLACEHOLDERS) + ", true)"
GOLD = f"""keyed AS (SELECT s.*, sig || '::' || coalesce(oh, '') AS cluster FROM sig_v s LEFT JOIN
    (SELECT case_id, array_to_string(list_sort(list(k) FILTER (length(k) > 3)), '_') AS oh FROM (SELECT case_id, substring({ALNUM.format('option_text')}, 1, 30) AS k FROM options_v) GROUP BY case_id) o USING (case_id) WHERE sig IS NOT NULL),
  mk AS (SELECT *, cluster || '::' || CASE WHEN bool_or(exam_type = 'A') OVER (PARTITION BY cluster) AND bool_or(exam_type = 'B') OVER (PARTITION BY cluster) AND exam_type = 'B' THEN 'B' ELSE 'A' END AS merge_key FROM keyed),
  rk AS (SELECT *, row_number() OVER (PARTITION BY merge_key ORDER BY coalesce(confidence, 0) DESC, case_id) AS rn FROM mk),
  gt AS (SELECT merge_key, arg_min(case_id, rn) AS host_id, list_sort(list(DISTINCT source)) AS merged_sources, count(*) AS n_merged, arg_min(rationale, rn) FILTER (NOT {HOLLOW.format('rationale')}) AS graft FROM rk GROUP BY merge_key)"""


@query(
    "DD03_golden_merge",
    f"""SELECT c.case_id, source, exam_type, CASE WHEN {HOLLOW.format('rationale')} THEN coalesce(graft, rationale) ELSE rationale END AS rationale,
      CASE WHEN len(merged_sources) > 1 THEN least(5.0, coalesce(nullif(confidence, 0), 3.0) + least((len(merged_sources) - 1) * CAST(0.15 AS DOUBLE), 0.5)) ELSE confidence END AS confidence,
      array_to_string(coalesce(merged_sources, [source]), ',') AS merged_sources, coalesce(n_merged, 1) AS n_merged, coalesce(len(merged_sources), 1) > 1 AS is_high_yield
    FROM cases_v c LEFT JOIN gt ON host_id = c.case_id WHERE c.case_id NOT IN (SELECT case_id FROM rk WHERE rn > 1)""",
    (*BOTH, SIG, GOLD),
)
def _(s, d):
    return merge.golden_merge(views.cases_with_options(s, d))[0].withColumn("merged_sources", F.array_join("merged_sources", ","))


def donors(s, d):
    """Cases with grafts: a pearl and distractors from the text, and tags, each missing in some."""
    c, i = views.cases_with_options(s, d), F.col("case_id")
    parts = F.split("question", " ")
    return (
        c.withColumn("pearl", F.when(i % 3 != 0, F.element_at(parts, 1)))
        .withColumn("distractors", F.create_map(F.lit("A"), F.when(i % 2 == 0, F.element_at(parts, 1)).otherwise(""), F.substring(F.lit("BCD"), (i % 3 + 1).cast("int"), F.lit(1)), F.concat("source", F.lit("!"))))
        .withColumn("tags", F.array("category", F.concat(F.lit("t"), (i % 4).cast("string"))))
    )


@query(
    "DD04_grafts",
    """, giv AS (SELECT case_id, string_split(question, ' ')[1] AS w, source, category FROM cases_v),
      all_g AS (SELECT r.merge_key, r.rn, g.case_id, CASE WHEN g.case_id % 3 <> 0 THEN w END AS pearl, CASE WHEN g.case_id % 2 = 0 THEN w ELSE '' END AS a,
        substring('BCD', CAST(g.case_id % 3 + 1 AS INTEGER), 1) AS k, g.source || '!' AS t, category, 't' || (g.case_id % 4) AS tag FROM giv g LEFT JOIN rk r USING (case_id)),
      grp AS (SELECT *, coalesce(merge_key, CAST(case_id AS VARCHAR)) AS g, coalesce(rn, 1) AS n FROM all_g)
    SELECT h.case_id, CASE WHEN coalesce(length(h.pearl), 0) < 5 THEN coalesce(arg_min(x.pearl, x.n) FILTER (length(x.pearl) > 5), h.pearl) ELSE h.pearl END AS pearl,
      concat_ws(';', 'A=' || arg_min(x.a, x.n) FILTER (x.a <> ''), 'B=' || arg_min(x.t, x.n) FILTER (x.k = 'B'), 'C=' || arg_min(x.t, x.n) FILTER (x.k = 'C'), 'D=' || arg_min(x.t, x.n) FILTER (x.k = 'D')) AS distractors,
      array_to_string(list_sort(list_distinct(list(x.category) || list(x.tag))), ',') AS tags
    FROM grp h JOIN grp x USING (g) WHERE h.n = 1 GROUP BY h.case_id, h.pearl""",
    (*BOTH, SIG, GOLD),
)
def _(s, d):
    entries = F.array_sort(F.map_entries("distractors"))
    said = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return merge.golden_merge(donors(s, d))[0].select("case_id", "pearl", said.alias("distractors"), F.array_join("tags", ",").alias("tags"))


@query(
    "DD05_consensus",
    """SELECT is_high_yield, count(*) AS n, round(sum(confidence), 6) AS confidence, count(confidence) AS rated FROM (
      SELECT CASE WHEN len(merged_sources) > 1 THEN least(5.0, coalesce(nullif(confidence, 0), 3.0) + least((len(merged_sources) - 1) * CAST(0.15 AS DOUBLE), 0.5)) ELSE confidence END AS confidence, coalesce(len(merged_sources), 1) > 1 AS is_high_yield
      FROM cases_v c LEFT JOIN gt ON host_id = c.case_id WHERE c.case_id NOT IN (SELECT case_id FROM rk WHERE rn > 1)) GROUP BY is_high_yield""",
    (*BOTH, SIG, GOLD),
)
def _(s, d):
    golden = merge.golden_merge(views.cases_with_options(s, d))[0]
    return golden.groupBy("is_high_yield").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"), F.count("confidence").alias("rated"))


@query("DD06_redirects", "SELECT case_id AS absorbed_id, host_id FROM rk JOIN gt USING (merge_key) WHERE rn > 1", (*BOTH, SIG, GOLD))
def _(s, d):
    return merge.golden_merge(views.cases_with_options(s, d))[1]


@query("DD19_fix_ids", "SELECT pos, CASE WHEN rn = 1 THEN k ELSE m + row_number() OVER (PARTITION BY rn > 1 ORDER BY pos) END AS new_id FROM (SELECT pos, pos // 2 AS k, row_number() OVER (PARTITION BY pos // 2 ORDER BY pos) AS rn, max(pos // 2) OVER () AS m FROM cases_v)")
def _(s, d):
    c = views.cases(s, d).select("pos", F.floor(F.col("pos") / 2).alias("case_id"))
    return dedup.fix_ids(c).select("pos", "new_id")


@query("DD20_dedupe_options", f"""SELECT case_id, CASE WHEN kept >= 2 THEN kept ELSE n END AS n, CASE WHEN kept >= 2 THEN kept_right ELSE n_right END > 1 AS review_options FROM (SELECT c.case_id, count(o.case_id) AS n, count(*) FILTER (is_correct) AS n_right, count(*) FILTER (rn = 1) AS kept, count(*) FILTER (rn = 1 AND is_correct) AS kept_right
    FROM cases_v c LEFT JOIN (SELECT case_id, is_correct, row_number() OVER (PARTITION BY case_id, {NORM.format('option_text')} ORDER BY is_correct DESC, slot) AS rn FROM options_v) o ON o.case_id = c.case_id GROUP BY c.case_id)""", BOTH)
def _(s, d):
    return dedup.dedupe_options(views.cases_with_options(s, d)).select("case_id", F.size("options").alias("n"), "review_options")


@query("PR11_assign_ids", "SELECT case_id, row_number() OVER (ORDER BY score DESC, case_id) AS seq FROM cases_v")
def _(s, d):
    c = views.cases(s, d).withColumn("back", -F.col("score"))
    return ids.dense_numbers(c, ["back", "case_id"], "seq").select("case_id", "seq")


@query(
    "WN01_case_codes",
    """SELECT case_id, src || '-' || cat || '-' || typ || '-' || lpad(CAST(row_number() OVER (PARTITION BY src, cat, typ ORDER BY pos) AS VARCHAR), 5, '0') AS case_code FROM (
      SELECT case_id, pos, rpad(upper(substring(replace(source, 'src', 'S'), 1, 3)), 3, 'X') AS src, rpad(upper(category), 3, 'X') AS cat, rpad(upper(substring(exam_type, 1, 3)), 3, 'X') AS typ FROM cases_v)""",
)
def _(s, d):
    return ids.assign_case_codes(views.cases(s, d)).select("case_id", "case_code")


@query("AG01_counts", " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM cases_v GROUP BY {c}" for c in ("source", "category", "exam_type", "status")))
def _(s, d):
    return report.counts(views.cases(s, d), ["source", "category", "exam_type", "status"])


@query("AG02_source_report", "SELECT source, count(*) AS total, count(*) FILTER (length(rationale) > 10) AS with_rationale, round(avg(score) FILTER (score > 0), 4) AS mean_score FROM cases_v GROUP BY source")
def _(s, d):
    return report.source_report(views.cases(s, d))


@query("AG03_confidence_hist", "SELECT CASE WHEN coalesce(confidence, 0) >= 4 THEN 'high' WHEN coalesce(confidence, 0) >= 3 THEN 'medium' WHEN coalesce(confidence, 0) >= 2 THEN 'low' ELSE 'poor' END AS band, count(*) AS n FROM cases_v GROUP BY 1")
def _(s, d):
    return report.confidence_hist(views.cases(s, d))


@query("AG05_quality_hist", "SELECT CAST(least(floor(score / 20), 4) AS INTEGER) AS band, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM cases_v), 4) AS share FROM cases_v GROUP BY 1")
def _(s, d):
    return report.quality_hist(views.cases(s, d))


TARGETS = {"en": 50.0, "de": 30.0, "fr": 10.0, "es": 8.0, "it": 2.0}


@query(
    "AG06_coverage",
    f"""SELECT category, n, share, gap, CASE WHEN gap < -3 THEN 'under' WHEN gap > 5 THEN 'excess' ELSE 'ok' END AS verdict FROM (SELECT category, n, share, round(share - coalesce(target, 0), 1) AS gap FROM (
      SELECT category, coalesce(n, 0) AS n, target, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM cases_v), 1) AS share FROM (SELECT category, count(*) AS n FROM cases_v GROUP BY category)
      FULL JOIN (VALUES {', '.join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in TARGETS.items())}) t(category, target) USING (category)))""",
)
def _(s, d):
    return report.coverage(views.cases(s, d), TARGETS)


@query("AG12_psychometrics", "SELECT count(*) AS n, round(avg(rl), 4) AS mean_right, round(avg(wl), 4) AS mean_wrong, count(*) FILTER (rl > wl) AS right_longer, count(*) FILTER (ra) AS absolute_right, count(*) FILTER (wa) AS absolute_wrong, " + ", ".join(f"count(*) FILTER (sl = '{x}') AS slot_{x.lower()}" for x in "ABCD") + r""" FROM (
  SELECT case_id, max(length(option_text)) FILTER (is_correct) AS rl, avg(length(option_text)) FILTER (NOT is_correct) AS wl, bool_or(is_correct AND regexp_matches(option_text, '(?i)\b(always|never|all|none|only)\b')) AS ra, bool_or(NOT is_correct AND regexp_matches(option_text, '(?i)\b(always|never|all|none|only)\b')) AS wa, max(option_id) FILTER (is_correct) AS sl
  FROM options_v GROUP BY case_id HAVING count(*) FILTER (is_correct) = 1 AND count(*) FILTER (NOT is_correct) > 0)""", BOTH)
def _(s, d):
    return report.psychometrics(views.cases_with_options(s, d))


@query(
    "AG14_length_stats",
    "SELECT count(*) AS n, min(l) AS shortest, list_sort(list(l))[1 + CAST(floor(count(*) * 0.25) AS INTEGER)] AS p25, list_sort(list(l))[1 + CAST(floor(count(*) * 0.5) AS INTEGER)] AS median, list_sort(list(l))[1 + CAST(floor(count(*) * 0.75) AS INTEGER)] AS p75, max(l) AS longest, round(avg(l), 4) AS mean FROM (SELECT length(question) AS l FROM cases_v)",
)
def _(s, d):
    return report.length_stats(views.cases(s, d), "question")


HELD = "(quarantined OR starts_with(status, 'QUARANTINED'))"


@query("FL01_quarantined", f"SELECT case_id FROM cases_v WHERE {HELD}")
def _(s, d):
    return views.cases(s, d).where(report.is_quarantined()).select("case_id")


@query("FL02_playable", f"SELECT case_id FROM cases_v WHERE NOT {HELD} AND NOT needs_review AND NOT truncated")
def _(s, d):
    return views.cases(s, d).where(report.is_playable()).select("case_id")


@query("FL08_telemetry_gate", "SELECT event_id, case_id, user_hash FROM telemetry_v WHERE case_id IS NOT NULL AND time_ms BETWEEN 1500 AND 3600000", (TELEMETRY_SQL,))
def _(s, d):
    return report.telemetry_gate(views.telemetry(s, d)).select("event_id", "case_id", "user_hash")


FIRST = "first_v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, user_hash ORDER BY ts, event_id) AS rn FROM telemetry_v WHERE case_id IS NOT NULL AND time_ms BETWEEN 1500 AND 3600000) WHERE rn = 1)"


@query("ST01_first_answers", "SELECT case_id, user_hash, is_correct, time_ms, event_id FROM first_v", (TELEMETRY_SQL, FIRST))
def _(s, d):
    return report.first_answers(views.telemetry(s, d))


@query("ST02_item_stats", "SELECT case_id, count(*) AS n, round(avg(CAST(is_correct AS INTEGER)), 4) AS accuracy, round(avg(time_ms), 2) AS mean_ms FROM first_v GROUP BY case_id", (TELEMETRY_SQL, FIRST))
def _(s, d):
    return report.item_stats(views.telemetry(s, d))


@query("AG08_feedback_counts", "SELECT count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'dismissed') AS dismissed, count(*) AS total FROM feedback_v", (FEEDBACK_SQL,))
def _(s, d):
    return report.feedback_counts(views.feedback(s, d))


@query(
    "AG09_top_flagged",
    """SELECT case_id, count(*) AS tag_rows, count(DISTINCT id) AS reports, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, min(created_at) AS first_at, max(created_at) AS last_at, count(*) FILTER (status = 'open') AS open_rows
    FROM (SELECT id, case_id, status, created_at, unnest(tags) AS tag FROM feedback_v) GROUP BY case_id ORDER BY tag_rows DESC, case_id LIMIT 20""",
    (FEEDBACK_SQL,),
)
def _(s, d):
    return report.top_flagged(views.feedback(s, d), 20)


@query("TK01_page", "SELECT id, case_id, status FROM feedback_v ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100", (FEEDBACK_SQL,))
def _(s, d):
    return report.page(views.feedback(s, d), 50, 100).select("id", "case_id", "status")


NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@query("AG11_recent_strikes", f"SELECT user_hash, count(*) AS strikes FROM feedback_v WHERE created_at > {NOW} - INTERVAL 7 DAYS GROUP BY user_hash", (FEEDBACK_SQL,))
def _(s, d):
    return report.recent_strikes(views.feedback(s, d), F.expr(NOW))


@query("TK07_edits_since", f"SELECT case_id, max(created_at) AS last_at FROM feedback_v WHERE created_at >= {NOW} - INTERVAL 12 HOURS GROUP BY case_id", (FEEDBACK_SQL,))
def _(s, d):
    return report.edits_since(views.feedback(s, d), F.expr(f"{NOW} - INTERVAL 12 HOURS"))


@query("AG18_progress", "SELECT category, count(*) AS total, count(d) AS done FROM cases_v LEFT JOIN (SELECT DISTINCT case_id, 1 AS d FROM telemetry_v) t USING (case_id) GROUP BY category", (CASES_SQL, TELEMETRY_SQL))
def _(s, d):
    return report.progress(views.cases(s, d), views.telemetry(s, d))


@query("AG19_bank_health", f"SELECT count(*) AS total, count(*) FILTER (NOT {HELD} AND NOT needs_review AND NOT truncated) AS clean, count(*) FILTER ({HELD}) AS held, count(*) FILTER (needs_review) AS review, count(*) FILTER (truncated) AS cut FROM cases_v")
def _(s, d):
    return report.bank_health(views.cases(s, d))


@query(
    "AG20_accuracy",
    """SELECT category, n, hits, percent, CASE WHEN percent < 70 AND n >= 2 THEN 'weak' ELSE 'strong' END AS area FROM (SELECT category, count(*) AS n, CAST(sum(CAST(is_correct AS INTEGER)) AS BIGINT) AS hits,
      CAST(floor(sum(CAST(is_correct AS INTEGER)) * 100 / count(*) + 0.5) AS BIGINT) AS percent FROM first_v JOIN cases_v USING (case_id) GROUP BY category)""",
    (CASES_SQL, TELEMETRY_SQL, FIRST),
)
def _(s, d):
    return report.accuracy_by_category(report.first_answers(views.telemetry(s, d)), views.cases(s, d))


@query("WN07_percentile", "SELECT min(value) AS value FROM (SELECT value, sum(n) OVER (ORDER BY value) AS cum, sum(n) OVER () AS t FROM (SELECT score AS value, count(*) AS n FROM cases_v GROUP BY score)) WHERE cum >= 0.9 * t")
def _(s, d):
    return report.percentile_of_hist(views.cases(s, d).groupBy(F.col("score").alias("value")).agg(F.count(F.lit(1)).alias("n")), 0.9)


@query(
    "WN08_streaks",
    """SELECT user_hash, CAST(min(day) AS VARCHAR) AS first_day, count(*) AS days FROM (SELECT user_hash, day, day - CAST(row_number() OVER (PARTITION BY user_hash ORDER BY day) AS INTEGER) AS island FROM (SELECT DISTINCT user_hash, CAST(ts AS DATE) AS day FROM telemetry_v)) GROUP BY user_hash, island""",
    (TELEMETRY_SQL,),
)
def _(s, d):
    return report.streaks(views.telemetry(s, d)).withColumn("first_day", F.col("first_day").cast("string"))


@query("TK06_top_counts", "SELECT source AS value, count(*) AS n FROM cases_v GROUP BY source ORDER BY n DESC, value LIMIT 7")
def _(s, d):
    return report.top_counts(views.cases(s, d), "source", 7)


@query("TK04_daily_order", "SELECT case_id, case_id IN (SELECT case_id FROM telemetry_v WHERE case_id IS NOT NULL) AS seen FROM cases_v", (CASES_SQL, TELEMETRY_SQL))
def _(s, d):
    return report.daily_order(views.cases(s, d), "2024-01-20", views.telemetry(s, d)).select("case_id", "seen")


@query("TK05_sample_exam", f"SELECT case_id, category FROM (SELECT * FROM cases_v WHERE NOT {HELD} AND NOT needs_review AND NOT truncated ORDER BY sha256('7|' || case_id), case_id LIMIT 100)")
def _(s, d):
    return report.sample_exam(views.cases(s, d).where(report.is_playable()), 100, 7).select("case_id", "category")


@query(
    "FN02_comparable",
    f"SELECT case_id, {NORM.format('question')} AS normal FROM cases_v",
)
def _(s, d):
    return views.cases(s, d).select("case_id", text.comparable("question").alias("normal"))


@query(
    "FN10_difficulty",
    r"""SELECT case_id, CASE WHEN n > 100 THEN 0.4 WHEN n > 60 THEN 0.6 ELSE 0.75 END::DOUBLE AS difficulty FROM (SELECT case_id, len(list_filter(regexp_split_to_array(question, '\s+'), lambda w: w <> '')) AS n FROM cases_v)""",
)
def _(s, d):
    return views.cases(s, d).select("case_id", text.difficulty("question").alias("difficulty"))


# Raw rows for the key checks: the options of a case under another id, with a shifted key for every seventh.
RAW_SQL = """fp_v AS (SELECT case_id, array_to_string(list_sort(list(substring(trim(lower(option_text)), 1, 30))), '|') AS fp FROM options_v GROUP BY case_id),
  raw_v AS (SELECT CASE WHEN o.case_id % 5 = 0 THEN o.case_id END AS case_id, fp, option_text AS answer, o.case_id AS pos FROM options_v o JOIN fp_v USING (case_id)
    WHERE slot - 1 = CASE WHEN o.case_id % 7 = 0 THEN (o.case_id + 1) % 4 ELSE o.case_id % 4 END)"""
KEYS = (CASES_SQL, OPTIONS_SQL, RAW_SQL)


def raw_rows(s, d):
    """(bank fingerprints, options, raw rows)"""
    o = views.options(views.cases(s, d))
    bank = keys.fingerprints(o)
    i = F.col("case_id")
    shown = F.when(i % 7 == 0, (i + 1) % 4).otherwise(i % 4)
    raw = o.join(bank, "case_id").where(F.col("slot") - 1 == shown).select(F.when(i % 5 == 0, i).alias("case_id"), "fp", F.col("option_text").alias("answer"), i.alias("pos"))
    return bank, o, raw


@query(
    "JN01_match_raw",
    """SELECT f.case_id, coalesce(i.a, p.a) AS answer, CASE WHEN i.a IS NOT NULL THEN 'id' WHEN p.a IS NOT NULL THEN 'options' ELSE 'none' END AS how FROM fp_v f
    LEFT JOIN (SELECT case_id, arg_max(answer, pos) AS a FROM raw_v WHERE case_id IS NOT NULL GROUP BY case_id) i USING (case_id)
    LEFT JOIN (SELECT fp, arg_max(answer, pos) AS a FROM raw_v WHERE fp <> '' GROUP BY fp) p USING (fp)""",
    KEYS,
)
def _(s, d):
    bank, _o, raw = raw_rows(s, d)
    return keys.match_raw(bank, raw)


@query(
    "JN02_heal_keys",
    f"""SELECT case_id, action, CASE WHEN action = 'heal' THEN new_key END AS new_key FROM (SELECT f.case_id, new_key, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN regexp_matches(answer, '^(all|none) of the above$') THEN 'all_of_above'
      WHEN new_key IS NULL THEN 'absent' WHEN already THEN 'keep' ELSE 'heal' END AS action
    FROM fp_v f LEFT JOIN (SELECT fp, count(DISTINCT {NORM.format('answer')}) AS n, min({NORM.format('answer')}) AS answer FROM raw_v GROUP BY fp) r USING (fp)
    LEFT JOIN (SELECT case_id, min(option_id) AS new_key, bool_or(is_correct) AS already FROM options_v JOIN fp_v USING (case_id)
      JOIN (SELECT fp, min({NORM.format('answer')}) AS answer FROM raw_v GROUP BY fp HAVING count(DISTINCT {NORM.format('answer')}) = 1) x USING (fp)
      WHERE {NORM.format('option_text')} = answer GROUP BY case_id) k ON k.case_id = f.case_id)""",
    KEYS,
)
def _(s, d):
    return keys.heal_keys(*raw_rows(s, d))


@query("JN03_anchor_map", "SELECT fp, min(answer) AS answer, count(DISTINCT answer) > 1 AS ambiguous FROM raw_v GROUP BY fp", KEYS)
def _(s, d):
    return keys.anchor_map(raw_rows(s, d)[2])


@query(
    "JN06_anchor_fuzzy",
    f"""SELECT case_id, option_id, d1 AS distance FROM (SELECT case_id, arg_min(option_id, rn) AS option_id, min(d) AS d1, coalesce(max(d) FILTER (rn = 2), 99) AS d2 FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY d, slot) AS rn FROM (SELECT o.case_id, option_id, slot, levenshtein({ALNUM.format('option_text')}, {ALNUM.format('anchor')}) AS d
        FROM options_v o JOIN (SELECT case_id, substring(option_text, 2, 60) AS anchor FROM options_v WHERE is_correct) a USING (case_id)))
      WHERE rn <= 2 GROUP BY case_id) WHERE (d1 = 0 AND d2 > 0) OR (d1 <= 2 AND d2 - d1 >= 2)""",
    BOTH,
)
def _(s, d):
    o = views.options(views.cases(s, d))
    anchors = o.where("is_correct").select("case_id", text.alnum(F.substring("option_text", 2, 60)).alias("anchor"))
    return keys.anchor_fuzzy(o.withColumn("option_text", text.alnum("option_text")), anchors)


@query("JN07_any_key", "SELECT case_id, key, patch FROM (SELECT case_id, unnest([CAST(case_id AS VARCHAR), 'h' || case_id]) AS key FROM cases_v) JOIN (SELECT CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'h' || doc_id END AS key, quality AS patch FROM labels) USING (key)")
def _(s, d):
    c = views.cases(s, d).select("case_id", F.concat(F.lit("h"), "case_id").alias("hash_id"), F.lit(None).cast("string").alias("case_code"))
    i = F.col("doc_id")
    patches = views.table(s, d, "labels").select(F.when(i % 2 == 0, i.cast("string")).otherwise(F.concat(F.lit("h"), i)).alias("key"), F.col("quality").alias("patch"))
    return keys.join_any_key(c, patches)


@query("JN08_apply_manifest", "SELECT case_id, source FROM cases_v WHERE case_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(s, d):
    return keys.apply_manifest(views.cases(s, d), views.table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("case_id"))).select("case_id", "source")


@query(
    "JN09_reverse_lookup",
    f"""SELECT case_id, option_id, arg_min(word, ix) AS word, array_to_string(arg_min(categories, ix), ',') AS categories FROM (
      SELECT w.case_id, option_id, ix, word, categories FROM (SELECT case_id, option_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS ix FROM (SELECT case_id, option_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS ws FROM (
        SELECT case_id, option_id, list_filter(string_split({NORM.format('option_text')}, ' '), lambda x: length(x) >= 7) AS l FROM options_v WHERE NOT is_correct))) w
      JOIN (SELECT word, list_sort(list(DISTINCT category))[1:2] AS categories, min(case_id) AS lo, max(case_id) AS hi FROM (SELECT case_id, unnest(list_filter(string_split({NORM.format('option_text')}, ' '), lambda x: length(x) >= 7)) AS word FROM options_v WHERE is_correct)
        JOIN cases_v USING (case_id) GROUP BY word) r USING (word) WHERE lo <> w.case_id OR hi <> w.case_id) GROUP BY case_id, option_id""",
    BOTH,
)
def _(s, d):
    c = views.cases(s, d)
    return keys.reverse_lookup(views.options(c), c)


@query("JN10_backfill", "SELECT a.case_id, coalesce(nullif(t, ''), b.title) AS title FROM (SELECT case_id, CASE WHEN case_id % 3 = 0 THEN '' ELSE title END AS t FROM cases_v) a JOIN cases_v b USING (case_id)")
def _(s, d):
    c = views.cases(s, d).select("case_id", "title")
    holes = c.withColumn("title", F.when(F.col("case_id") % 3 == 0, "").otherwise(F.col("title")))
    return keys.backfill(holes, c, "case_id", ["title"])


@query(
    "JN13_zip_ranked",
    "SELECT case_id, page_id FROM (SELECT case_id, row_number() OVER (ORDER BY case_id) AS r FROM cases_v WHERE needs_review) JOIN (SELECT page_id, row_number() OVER (ORDER BY page_id) AS r FROM pages) USING (r)",
)
def _(s, d):
    return keys.zip_ranked(views.cases(s, d).where("needs_review").select("case_id"), views.table(s, d, "pages").select("page_id"), ["case_id"], ["page_id"])


@query(
    "AG22_key_crosscheck",
    f"""SELECT count(*) AS checked, count(*) FILTER (own = {NORM.format('answer')}) AS equal FROM (SELECT f.case_id, coalesce(i.a, p.a) AS answer FROM fp_v f
    LEFT JOIN (SELECT case_id, arg_max(answer, pos) AS a FROM raw_v WHERE case_id IS NOT NULL GROUP BY case_id) i USING (case_id)
    LEFT JOIN (SELECT fp, arg_max(answer, pos) AS a FROM raw_v WHERE fp <> '' GROUP BY fp) p USING (fp)) JOIN (SELECT case_id, min({NORM.format('option_text')}) AS own FROM options_v WHERE is_correct GROUP BY case_id) USING (case_id) WHERE answer IS NOT NULL""",
    KEYS,
)
def _(s, d):
    bank, _o, raw = raw_rows(s, d)
    return keys.key_crosscheck(keys.match_raw(bank, raw), answers(s, d))


LANGS = ["en", "de", "fr"]
AGG_OPTS = f"""agg_v AS (SELECT c.*, coalesce(n, 0) AS n_options, coalesce(nr, 0) AS n_right, coalesce(nd, 0) AS n_distinct, coalesce(nl, 0) AS n_lower, coalesce(longest, 0) AS longest, coalesce(first_right, '') AS first_right, mean_wrong, nw, absolute, poison FROM cases_v c LEFT JOIN (
    SELECT case_id, count(*) AS n, count(*) FILTER (is_correct) AS nr, count(DISTINCT {NORM.format('option_text')}) AS nd, count(DISTINCT lower(option_text)) AS nl, max(length(option_text)) AS longest,
    min(option_text) FILTER (is_correct) AS first_right, avg(length(option_text)) FILTER (NOT is_correct) AS mean_wrong, count(*) FILTER (NOT is_correct) AS nw,
    bool_or(NOT is_correct AND regexp_matches(lower(option_text), '\\b(always|never|all|none)\\b')) AS absolute,
    bool_or(regexp_matches(lower(option_text), '(all|none) of the above|both [a-d] and [a-d]')) AS poison FROM options_v GROUP BY case_id) o USING (case_id))"""


def checks_sql(layer, checks):
    return " UNION ALL ".join(f"SELECT case_id, '{layer}' AS layer, '{c}' AS code, '{sv}' AS severity FROM agg_v WHERE {p}" for c, sv, p in checks)


A_CHECKS = [
    ("few_options", "critical", "n_options < 2"), ("no_correct", "critical", "n_right = 0"), ("multi_correct", "high", "n_right > 1"), ("empty_question", "critical", "trim(question) = ''"),
    ("same_options", "medium", "n_distinct < n_options"), ("brackets", "low", "length(regexp_replace(question, '[^(]', '', 'g')) <> length(regexp_replace(question, '[^)]', '', 'g'))"),
    ("trailing_stop_word", "low", "regexp_matches(lower(trim(question)), '\\b(the|a|an|of|and|or|with|to|in)$')"), ("no_terminal", "low", "trim(question) <> '' AND NOT regexp_matches(trim(question), '[.?!:]$')"),
    ("bad_category", "medium", "category NOT IN ('en', 'de', 'fr')"),
]
S_CHECKS = [
    ("length_bias", "medium", "nw > 0 AND n_right > 0 AND length(first_right) > 1.8 * mean_wrong"), ("absolutes_wrong", "low", "absolute"), ("shuffle_poison", "high", "poison"),
    ("negation", "low", "regexp_matches(lower(question), '\\b(except|not|false)\\b')"),
]
AUDIT = (CASES_SQL, OPTIONS_SQL, AGG_OPTS)


@query("QA01_structure", checks_sql("A", A_CHECKS), AUDIT)
def _(s, d):
    return audit.audit_structure(views.cases_with_options(s, d), LANGS)


@query("QA15_screening", checks_sql("S", S_CHECKS), AUDIT)
def _(s, d):
    return audit.screening(views.cases_with_options(s, d))


BUCKETS = {"hash_run": "#{2,}", "star_run": "[*]{2,}", "number": "[0-9]{4,}", "mail": "[a-z0-9.]+@[a-z0-9.]+"}


@query(
    "QA19_text_artifacts",
    " UNION ALL ".join(
        f"SELECT case_id, '{f}' AS field, '{b}' AS bucket, regexp_extract({f}, '{p}') AS found FROM cases_v WHERE regexp_extract({f}, '{p}') <> ''" for f in ("title", "narrative", "rationale") for b, p in BUCKETS.items()
    ),
)
def _(s, d):
    return audit.text_artifacts(views.cases(s, d), ["title", "narrative", "rationale"], BUCKETS)


@query(
    "AG04_issue_report",
    " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM ({checks_sql('A', A_CHECKS)} UNION ALL {checks_sql('S', S_CHECKS)}) GROUP BY {c}" for c in ("severity", "layer", "code")),
    AUDIT,
)
def _(s, d):
    c = views.cases_with_options(s, d)
    return audit.issue_report(audit.audit_structure(c, LANGS).unionByName(audit.screening(c)))


@query(
    "SE01_manifest",
    f"SELECT case_id, arg_min(code, layer || code) AS code, count(*) AS n_issues FROM ({checks_sql('A', A_CHECKS)} UNION ALL {checks_sql('S', S_CHECKS)}) WHERE severity = 'critical' OR code IN ('same_options', 'length_bias') GROUP BY case_id",
    AUDIT,
)
def _(s, d):
    c = views.cases_with_options(s, d)
    return audit.build_manifest(audit.audit_structure(c, LANGS).unionByName(audit.screening(c)), ["same_options", "length_bias"])


@query("SE03_release", "SELECT case_id, status AS code FROM cases_v WHERE quarantined AND case_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(s, d):
    held = views.cases(s, d).where("quarantined").select("case_id", F.col("status").alias("code"))
    return audit.release(held, views.table(s, d, "labels").where("quality = 0").select(F.col("doc_id").alias("case_id")))


@query("SE04_extend_manifest", "SELECT case_id, 'held' AS code FROM cases_v WHERE quarantined UNION ALL SELECT case_id, 'cut' FROM cases_v WHERE truncated AND NOT quarantined")
def _(s, d):
    c = views.cases(s, d)
    return audit.extend_manifest(c.where("quarantined").select("case_id", F.lit("held").alias("code")), c.where("truncated").select("case_id", F.lit("cut").alias("code")))


@query(
    "SE02_union_queues",
    """SELECT case_id, max(priority) AS priority, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM (SELECT case_id, 3 AS priority, 'review' AS reason FROM cases_v WHERE needs_review
    UNION ALL SELECT case_id, difficulty, 'cut' FROM cases_v WHERE truncated UNION ALL SELECT case_id, difficulty, 'any' FROM cases_v WHERE truncated) GROUP BY case_id""",
)
def _(s, d):
    c = views.cases(s, d)
    a = c.where("needs_review").select("case_id", F.lit(3).alias("priority"), F.array(F.lit("review")).alias("reasons"))
    return audit.union_queues(a, c.where("truncated").select("case_id", F.col("difficulty").alias("priority"), F.array(F.lit("cut"), F.lit("any")).alias("reasons"))).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "QA22_publish_violations",
    """SELECT (SELECT count(*) FROM (SELECT case_id, count(*) OVER (PARTITION BY case_id) AS k FROM cases_v) WHERE k > 1) AS repeated_ids, count(*) FILTER (n_right <> 1) AS not_one_correct, count(*) FILTER (NOT score BETWEEN 0 AND 100) AS score_out_of_range,
    count(*) FILTER (n_distinct < n_options) AS repeated_options, count(*) FILTER (length(trim(question)) < 10) AS short_stems, count(*) FILTER (length(rationale) = 0) AS no_rationale FROM agg_v""",
    AUDIT,
)
def _(s, d):
    return audit.publish_violations(views.cases_with_options(s, d))


@query("FL05_corruption", r"""SELECT case_id, reason FROM (SELECT case_id, CASE WHEN length(trim(t)) < 20 THEN 'too_short' WHEN length(regexp_replace(t, '[^A-Za-z]', '', 'g')) > 40 AND length(regexp_replace(t, '[^A-Z]', '', 'g')) * 10 > length(regexp_replace(t, '[^A-Za-z]', '', 'g')) * 8 THEN 'garbled_caps'
    WHEN regexp_matches(t, '\x{FFFD}{2,}|(Ã.){3,}') THEN 'encoding_garbage' WHEN regexp_matches(trim(t), '[,;(]$') THEN 'truncated' WHEN five THEN 'repetitive' WHEN length(t) > 60 AND nw * 30 < length(t) THEN 'no_spaces' END AS reason
  FROM (SELECT case_id, question AS t, len(list_filter(string_split_regex(trim(question), '\s+'), lambda x: x <> '')) AS nw, len(list_filter(range(1, len(ws) - 3), lambda j: regexp_matches(ws[j], '^\w+$') AND ws[j] = ws[j + 1] AND ws[j] = ws[j + 2] AND ws[j] = ws[j + 3] AND ws[j] = ws[j + 4])) > 0 AS five FROM (SELECT *, string_split(lower(question), ' ') AS ws FROM cases_v))) WHERE reason IS NOT NULL""")
def _(s, d):
    return views.cases(s, d).select("case_id", audit.corruption_reason(F.col("question")).alias("reason")).where("reason is not null")


# Verdicts: conversation turns as results of a case, confidence by turn.
RESULTS_SQL = """results_v AS (SELECT conv_id AS case_id, turn AS pos, chr(CAST(65 + (conv_id + turn // 2) % 2 AS INTEGER)) AS option, CASE turn % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  'f' || lpad(CAST(turn AS VARCHAR), 4, '0') AS file, text FROM conversations)"""


def results(s, d):
    t = F.col("turn")
    return views.table(s, d, "conversations").select(
        F.col("conv_id").alias("case_id"), t.alias("pos"), F.when((F.col("conv_id") + F.floor(t / 2)) % 2 == 0, "A").otherwise("B").alias("option"),
        F.when(t % 3 == 0, "HIGH").when(t % 3 == 1, "MEDIUM").otherwise("LOW").alias("confidence"), F.concat(F.lit("f"), F.lpad(t.cast("string"), 4, "0")).alias("file"), "text",
    )


VERDICTS = """SELECT case_id, CASE WHEN n = 0 THEN 'keep_review' WHEN n = 1 THEN 'apply' ELSE 'conflict' END AS action, CASE WHEN n = 1 THEN o END AS option, CASE WHEN n = 1 THEN f END AS file FROM (
  SELECT case_id, count(DISTINCT option) FILTER (confidence = 'HIGH') AS n, min(option) FILTER (confidence = 'HIGH') AS o, min(file) FILTER (confidence = 'HIGH') AS f FROM results_v GROUP BY case_id)"""


@query("EN06_verdicts", VERDICTS, (RESULTS_SQL,))
def _(s, d):
    return review.merge_verdicts(results(s, d))


@query("AG24_patch_stats", f"SELECT action AS outcome, count(*) AS n FROM ({VERDICTS}) GROUP BY 1", (RESULTS_SQL,))
def _(s, d):
    return review.patch_stats(review.merge_verdicts(results(s, d)))


@query(
    "EN07_apply_results",
    """SELECT case_id, arg_max(coalesce(full_rationale, explanation), row(l = 3, pos)) FILTER (coalesce(full_rationale, explanation) IS NOT NULL) AS rationale, arg_max(answer, pos) FILTER (l = 2) AS new_key, max(l) AS level FROM (
      SELECT *, CASE WHEN full_rationale IS NOT NULL THEN 3 WHEN answer IS NOT NULL THEN 2 ELSE 1 END AS l FROM (
        SELECT case_id, pos, CASE WHEN case_id % 4 = 0 AND pos = 1 THEN text END AS full_rationale, CASE WHEN pos % 2 = 0 THEN option END AS answer, CASE WHEN pos % 2 = 1 THEN substring(text, 1, 50) END AS explanation FROM results_v)) GROUP BY case_id""",
    (RESULTS_SQL,),
)
def _(s, d):
    pos = F.col("pos")
    kinds = results(s, d).select(
        "case_id", "pos", F.when((F.col("case_id") % 4 == 0) & (pos == 1), F.col("text")).alias("full_rationale"), F.when(pos % 2 == 0, F.col("option")).alias("answer"), F.when(pos % 2 == 1, F.substring("text", 1, 50)).alias("explanation")
    )
    return review.apply_results(kinds)


@query(
    "EN09_answer_audit",
    """SELECT o.case_id, option_id, CASE confidence WHEN 'HIGH' THEN option_id = option WHEN 'MEDIUM' THEN is_correct OR option_id = option ELSE is_correct END AS is_correct
    FROM options_v o LEFT JOIN (SELECT case_id, option, CASE case_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM results_v WHERE pos = 0) r USING (case_id)""",
    (*BOTH, RESULTS_SQL),
)
def _(s, d):
    i = F.col("case_id") % 3
    found = results(s, d).where("pos = 0").select("case_id", "option", F.when(i == 0, "HIGH").when(i == 1, "MEDIUM").otherwise("LOW").alias("confidence"))
    return review.apply_answer_audit(views.options(views.cases(s, d)), found).select("case_id", "option_id", "is_correct")


@query("EN12_blind_votes", f"SELECT case_id, CASE WHEN {NORM.format('answer')} = {NORM.format('vote')} THEN 'agree' ELSE 'conflict' END AS outcome FROM ({ANSWERS}) JOIN (SELECT case_id, option_text AS vote FROM options_v WHERE slot = 1) USING (case_id)", BOTH)
def _(s, d):
    o = views.options(views.cases(s, d))
    return review.blind_votes(answers(s, d), o.where("slot = 1").select("case_id", F.col("option_text").alias("vote")))


@query("EN13_resolve_conflicts", "SELECT case_id, state, CASE WHEN state = 'flip' THEN 'B' ELSE key END AS key FROM (SELECT case_id, key, CASE WHEN key = 'B' THEN 'stale' WHEN score >= 80 THEN 'flip' ELSE 'hold' END AS state FROM (SELECT case_id, score, option_id AS key FROM options_v JOIN cases_v USING (case_id) WHERE is_correct))", BOTH)
def _(s, d):
    c = views.cases(s, d)
    keyed = views.options(c).where("is_correct").join(c.select("case_id", "score"), "case_id")
    return review.resolve_conflicts(keyed.select("case_id", F.col("option_id").alias("key"), F.lit("B").alias("audit_key"), F.col("score").alias("quality")))


@query("EN08_aligned", f"""SELECT case_id, (length(a) <= length(b) AND length(a) >= 24 AND contains(b, a)) OR (length(b) < length(a) AND length(b) >= 24 AND contains(a, b)) OR (least(len(x), len(y)) > 0 AND len(list_intersect(x, y)) >= 0.6 * least(len(x), len(y))) AS aligned
  FROM (SELECT *, list_distinct(list_filter(string_split(a, ' '), lambda w: w <> '')) AS x, list_distinct(list_filter(string_split(b, ' '), lambda w: w <> '')) AS y FROM (SELECT case_id, {NORM.format('title')} AS a, {NORM.format('rationale')} AS b FROM cases_v))""")
def _(s, d):
    c = views.cases(s, d)
    return c.select("case_id", review.aligned(F.col("title"), F.col("rationale")).alias("aligned"))


@query(
    "EN15_current_values",
    "SELECT case_id, max(new_value) FILTER (rn = 1 AND field = 'prompt') AS prompt, max(new_value) FILTER (rn = 1 AND field = 'options') AS options FROM (SELECT *, row_number() OVER (PARTITION BY case_id, field ORDER BY created_at DESC, id DESC) AS rn FROM (SELECT id, case_id, created_at, CASE WHEN id % 2 = 0 THEN 'prompt' ELSE 'options' END AS field, user_hash AS new_value FROM feedback_v)) GROUP BY case_id",
    (FEEDBACK_SQL,),
)
def _(s, d):
    edits = views.feedback(s, d).select("id", "case_id", "created_at", F.when(F.col("id") % 2 == 0, "prompt").otherwise("options").alias("field"), F.col("user_hash").alias("new_value"))
    return review.current_values(edits, ["prompt", "options"])


@query("SE06_unknown_cases", "SELECT case_id * 17 AS case_id, pos FROM results_v WHERE case_id * 17 NOT IN (SELECT case_id FROM cases_v)", (CASES_SQL, RESULTS_SQL))
def _(s, d):
    return review.unknown_cases(results(s, d).select((F.col("case_id") * 17).alias("case_id"), "pos"), views.cases(s, d))


@query("JN12_adjudicate", "SELECT case_id, option AS recommended FROM results_v WHERE (option = 'A' AND case_id % 2 = 0) OR (option = 'B' AND case_id % 3 = 0)", (RESULTS_SQL,))
def _(s, d):
    r = results(s, d).select("case_id", F.col("option").alias("recommended"))
    allowed = F.filter(F.array(F.when(F.col("case_id") % 2 == 0, F.lit("A")), F.when(F.col("case_id") % 3 == 0, F.lit("B"))), lambda x: x.isNotNull())
    return review.adjudicate(r, r.select("case_id").distinct().withColumn("allowed", allowed))


@query("WN10_number_packs", "SELECT case_id, status AS issue, (row_number() OVER (PARTITION BY status ORDER BY case_id) - 1) // 20 AS pack FROM cases_v")
def _(s, d):
    return review.number_packs(views.cases(s, d).select("case_id", F.col("status").alias("issue")), 20)


@query("SC10_conflict_lane", "SELECT case_id, CASE WHEN n_options < 2 THEN 'mechanical' WHEN n_right <> 1 THEN 'answer_key' ELSE 'clinical' END AS lane, n_options >= 2 AND n_right <> 1 AND score >= 80 AS phase_1 FROM agg_v WHERE status = 'QUARANTINED_AI_CONFLICT'", AUDIT)
def _(s, d):
    return review.conflict_lane(views.cases_with_options(s, d))


@query("EN04_recover_rationale", "SELECT case_id, CASE WHEN length(trim(title)) >= length(trim(rationale)) OR regexp_matches(lower(trim(rationale)), '^the') THEN CASE WHEN regexp_matches(lower(trim(title)), '^the') OR trim(title) = '' THEN CASE WHEN regexp_matches(lower(trim(rationale)), '^the') OR trim(rationale) = '' THEN NULL ELSE trim(rationale) END ELSE trim(title) END ELSE trim(rationale) END AS rationale FROM cases_v WHERE NOT ((regexp_matches(lower(trim(title)), '^the') OR trim(title) = '') AND (regexp_matches(lower(trim(rationale)), '^the') OR trim(rationale) = ''))")
def _(s, d):
    return review.recover_rationale(views.cases(s, d), ["title", "rationale"], "^the")


@query("EN16_panel_cases", """SELECT case_id, array_to_string(v, ',') AS votes, list_position(v, list_max(v)) AS peak FROM (SELECT case_id, CASE WHEN t BETWEEN 10 AND 20 THEN votes ELSE list_transform(votes, lambda x: CAST(floor(x * 15 / t + 0.5) AS INTEGER)) END AS v FROM (
  SELECT case_id, votes, list_sum(votes) AS t FROM (SELECT case_id, list_transform([1, 2, 3, 4, 5], lambda k: CAST((case_id * k) % 7 AS INTEGER)) AS votes FROM cases_v)) WHERE t > 0)""")
def _(s, d):
    i = F.col("case_id")
    votes = F.array(*[((i * k) % 7).cast("int") for k in range(1, 6)])
    return review.panel_cases(views.cases(s, d).select("case_id", votes.alias("votes"))).withColumn("votes", F.array_join(F.col("votes").cast("array<string>"), ","))


def review_log(s, d):
    grade = (1 + F.pmod("event_id", F.lit(4))).cast("int")
    return views.telemetry(s, d).select("user_hash", "case_id", "ts", F.col("event_id").alias("seq"), grade.alias("grade"))


@query("ST03_fold_reviews")
def _(s, d):
    st = memory.fold_reviews(review_log(s, d))
    return st.select("user_hash", "case_id", *[F.round(c, 6).alias(c) for c in ("difficulty", "stability", "last_review")], "lapses", "reviews")


@query("TK03_due_cards")
def _(s, d):
    return memory.due_cards(memory.fold_reviews(review_log(s, d)), 1_710_000_000.0).withColumn("retrievability", F.round("retrievability", 6))


@query("ST04_reset_corrected")
def _(s, d):
    st = memory.reset_corrected(memory.fold_reviews(review_log(s, d)), views.cases(s, d).where("quarantined").select("case_id"))
    return st.withColumns({c: F.round(c, 6) for c in ("difficulty", "stability", "last_review")})


@query("ST05_memory_stats")
def _(s, d):
    return memory.memory_stats(memory.fold_reviews(review_log(s, d)), 1_710_000_000.0)


FREQ = {"Alpha": ["the", "and", "of"], "Beta": ["die", "und", "der"], "Gamma": ["les", "est", "que"], "Delta": ["para", "las", "por"]}
PAIRS = ", ".join(f"('{c}', '{w}')" for c, ws in FREQ.items() for w in ws)
HITS_SQL = f"""hits_v AS (SELECT DISTINCT case_id, signal, category, word FROM (SELECT case_id, 'narrative' AS signal, unnest(string_split({NORM.format('narrative')}, ' ')) AS word FROM cases_v
    UNION ALL SELECT case_id, 'keyword', unnest(string_split({NORM.format('title')}, ' ')) FROM cases_v) JOIN (VALUES {PAIRS}) w(category, word) USING (word)),
  lab_v AS (SELECT case_id, CASE lang WHEN 'en' THEN 'Alpha' WHEN 'de' THEN 'Beta' WHEN 'fr' THEN 'Gamma' END AS category FROM (SELECT doc_id AS case_id, CASE WHEN doc_id % 4 = 0 THEN 'de' ELSE lang END AS lang FROM documents))"""


def labelled(s, d):
    lang = F.when(F.col("case_id") % 4 == 0, "de").otherwise(F.col("category"))
    c = views.cases(s, d)
    return c.withColumn("category", F.when(lang == "en", "Alpha").when(lang == "de", "Beta").when(lang == "fr", "Gamma"))


def hits(s, d):
    return category.match_keywords(views.cases(s, d), {"narrative": "narrative", "keyword": "title"}, FREQ)


@query("UD02_keyword_matches", "SELECT case_id, signal, category, word FROM hits_v", (CASES_SQL, HITS_SQL))
def _(s, d):
    return hits(s, d)


RESOLVED_SQL = """scored_v AS (SELECT case_id, category, sum(CASE signal WHEN 'raw' THEN 4 WHEN 'narrative' THEN 2 ELSE 1 END) + CASE WHEN count(*) FILTER (signal <> 'raw') >= 2 THEN 2 ELSE 0 END AS score FROM (
    SELECT DISTINCT case_id, signal, category FROM hits_v UNION ALL SELECT case_id, 'raw', category FROM lab_v WHERE category IS NOT NULL) GROUP BY case_id, category),
  two_v AS (SELECT case_id, max(category) FILTER (rn = 1) AS w, max(score) FILTER (rn = 1) AS ws, max(category) FILTER (rn = 2) AS r, coalesce(max(score) FILTER (rn = 2), 0) AS rs FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, category) AS rn FROM scored_v) WHERE rn <= 2 GROUP BY case_id),
  resolved_v AS (SELECT l.case_id, l.category AS raw, coalesce(w, 'Unclassified') AS resolved, coalesce(ws, 0) AS score, r AS runner_up, CASE WHEN ws >= 5 AND ws - rs >= 2 THEN 'high' WHEN ws >= 3 AND ws - rs >= 2 THEN 'medium' ELSE 'low' END AS confidence,
    coalesce(l.category <> w, false) OR coalesce(rs >= 3, false) AS conflict FROM lab_v l LEFT JOIN two_v USING (case_id))"""


@query("SC01_resolve_category", "SELECT case_id, resolved, CAST(score AS BIGINT) AS score, runner_up, confidence, conflict FROM resolved_v", (CASES_SQL, HITS_SQL, RESOLVED_SQL))
def _(s, d):
    return category.resolve_category(labelled(s, d), hits(s, d)).drop("runner_score")


@query(
    "SC04_apply_category",
    """SELECT r.case_id, coalesce(a.category, CASE WHEN confidence = 'high' THEN resolved ELSE coalesce(raw, 'Unclassified') END) AS final, a.category IS NULL AND confidence <> 'high' AND conflict AS review FROM resolved_v r
    LEFT JOIN (SELECT case_id, 'Delta' AS category FROM cases_v WHERE needs_review) a USING (case_id)""",
    (CASES_SQL, HITS_SQL, RESOLVED_SQL),
)
def _(s, d):
    c = labelled(s, d)
    done = category.resolve_category(c, hits(s, d)).join(c.select("case_id", F.col("category").alias("raw")), "case_id")
    return category.apply_category(done, c.where("needs_review").select("case_id", F.lit("Delta").alias("category"))).select("case_id", "final", "review")


@query("AG07_category_audit", "SELECT raw, resolved, count(*) AS n FROM resolved_v WHERE raw <> resolved GROUP BY raw, resolved ORDER BY n DESC, raw, resolved LIMIT 25", (CASES_SQL, HITS_SQL, RESOLVED_SQL))
def _(s, d):
    c = labelled(s, d)
    return category.category_audit(category.resolve_category(c, hits(s, d)).join(c.select("case_id", F.col("category").alias("raw")), "case_id"))


@query("SC05_map_sources", "SELECT case_id, coalesce(m, category) AS category FROM cases_v LEFT JOIN (VALUES ('src1', 'en'), ('src2', 'de')) t(source, m) USING (source)")
def _(s, d):
    table = s.createDataFrame([("src1", "en"), ("src2", "de"), ("src3", "xx")], "source string, category string")
    return category.map_sources(views.cases(s, d), table, ["en", "de"]).select("case_id", "category")


@query(
    "SC06_tag_topics",
    """SELECT c.case_id, coalesce(category, 'general') AS organ, coalesce(words, '') AS words FROM cases_v c LEFT JOIN (SELECT case_id, t.category, words FROM (SELECT case_id, category, array_to_string(list_sort(list(DISTINCT word))[1:8], ',') AS words, row_number() OVER (PARTITION BY case_id ORDER BY count(DISTINCT word) DESC, category) AS rn FROM hits_v GROUP BY case_id, category) t WHERE rn = 1) USING (case_id)""".replace("coalesce(category,", "coalesce(h.category,").replace("WHERE rn = 1) USING", "WHERE rn = 1) h USING"),
    (CASES_SQL, HITS_SQL),
)
def _(s, d):
    return category.tag_topics(hits(s, d), views.cases(s, d))


TAG_RULES = {"numbers": "[0-9]{3,}", "marks": "[#*%]{3}", "english": "the", "german": "sch"}


@query(
    "SC07_tags",
    "SELECT case_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(question), '{p}') THEN '{n}' END" for n, p in TAG_RULES.items()) + "], lambda x: x IS NOT NULL), ',') AS tags, CASE "
    + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{n}'" for n, p in TAG_RULES.items()) + " ELSE 'none' END AS first FROM cases_v",
)
def _(s, d):
    q = F.col("question")
    return views.cases(s, d).select("case_id", F.array_join(category.regex_tags(q, TAG_RULES), ",").alias("tags"), category.first_rule(q, TAG_RULES, "none").alias("first"))


@query("SC08_fill_gaps", "SELECT case_id, category FROM (SELECT case_id, category, row_number() OVER (PARTITION BY category ORDER BY case_id) AS rn FROM cases_v WHERE needs_review) JOIN (VALUES ('en', 5), ('de', 3)) n(category, needed) USING (category) WHERE rn <= needed")
def _(s, d):
    return category.fill_gaps(views.cases(s, d).where("needs_review").select("case_id", "category"), s.createDataFrame([("en", 5), ("de", 3)], "category string, needed int"))


@query("SC14_changed_only", "SELECT case_id, CASE WHEN needs_review THEN 'x' ELSE category END AS category FROM cases_v WHERE needs_review OR case_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    c = views.cases(s, d).select("case_id", "category", "needs_review")
    known = c.join(with_label(s, d), "case_id", "left_semi")
    return category.changed_only(known.drop("needs_review"), c.select("case_id", F.when(F.col("needs_review"), "x").otherwise(F.col("category")).alias("category")), "case_id", ["category"])


@query("FL03_browse", "SELECT case_id FROM cases_v WHERE category = 'en' AND exam_type IN ('A', 'BOTH') AND contains(lower(title || ' ' || question || ' ' || category), 'idiot') AND case_id NOT IN (SELECT case_id FROM telemetry_v WHERE case_id IS NOT NULL)", (CASES_SQL, TELEMETRY_SQL))
def _(s, d):
    return gates.browse(views.cases(s, d), category="en", exam="A", search="Idiot", done=views.telemetry(s, d).where("case_id is not null")).select("case_id")


@query("FL04_exam_pool", f"SELECT case_id FROM agg_v WHERE NOT {HELD} AND NOT needs_review AND NOT truncated AND exam_type IN ('B', 'BOTH') AND n_right = 1 AND n_options >= 4", AUDIT)
def _(s, d):
    return gates.exam_pool(views.cases_with_options(s, d), "B").select("case_id")


@query("FL07_flag_invalid", f"SELECT case_id FROM agg_v WHERE NOT {HELD} AND n_right <> 1", AUDIT)
def _(s, d):
    return gates.flag_invalid(views.cases_with_options(s, d))


@query("FL09_feedback_gate", "SELECT id, case_id, array_to_string(list_filter(tags, lambda t: t IN ('click', 'error', 'typo')), ',') AS tags FROM feedback_v WHERE case_id IS NOT NULL AND len(list_filter(tags, lambda t: t IN ('click', 'error', 'typo'))) > 0", (FEEDBACK_SQL,))
def _(s, d):
    fb = views.feedback(s, d).withColumn("comment", F.lit("<b>"))
    return gates.feedback_gate(fb, ("click", "error", "typo")).select("id", "case_id", F.array_join("tags", ",").alias("tags"))


@query("FL10_proposal_gate", "SELECT id, case_id, user_hash FROM feedback_v WHERE case_id IS NOT NULL AND id % 3 <> 0 AND status <> 'open' AND user_hash NOT IN (SELECT user_hash FROM feedback_v GROUP BY user_hash HAVING count(*) > 70)", (FEEDBACK_SQL,))
def _(s, d):
    fb = views.feedback(s, d)
    bans = fb.groupBy("user_hash").count().where("count > 70")
    sent = fb.select("id", "case_id", "user_hash", F.when(F.col("id") % 3 == 0, "nothing").otherwise("prompt").alias("field"), F.when(F.col("status") == "open", "abc").otherwise("A book").alias("reference"), F.lit("old").alias("old_value"), F.lit("new").alias("new_value"))
    return gates.proposal_gate(sent, bans).select("id", "case_id", "user_hash")


@query("FL12_thin_rationale", "SELECT case_id FROM agg_v WHERE length(trim(rationale)) < 80 OR lower(trim(rationale)) = lower(first_right)", AUDIT)
def _(s, d):
    return gates.thin_rationale(views.cases_with_options(s, d))


@query("FL13_health_screen", "SELECT case_id, CASE WHEN n_options >= 2 AND length(trim(question)) > 5 AND n_right > 0 THEN 'pass' ELSE 'hold' END AS label FROM agg_v", AUDIT)
def _(s, d):
    return gates.health_screen(views.cases_with_options(s, d))


@query("FL14_panel_candidates", f"SELECT case_id FROM agg_v WHERE NOT {HELD} AND length(narrative) >= 50 AND n_options >= 4 AND n_right > 0 AND category IN ('en', 'fr')", AUDIT)
def _(s, d):
    return gates.panel_candidates(views.cases_with_options(s, d), ["en", "fr"])


@query("IO05_relational", "SELECT case_id, slot - 1 AS sort_order, option_id, option_text, CAST(is_correct AS INTEGER) AS is_correct FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY slot) AS slot, option_id, option_text, is_correct FROM options_v)", BOTH)
def _(s, d):
    return io.to_relational(views.cases_with_options(s, d), 1)[1].withColumn("sort_order", F.col("sort_order").cast("long"))


@query("IO06_from_relational", "SELECT case_id, count(o.case_id) AS n, coalesce(array_to_string(list(option_id ORDER BY slot), ''), '') AS ids FROM (SELECT case_id AS id FROM cases_v) c LEFT JOIN options_v o ON o.case_id = c.id GROUP BY c.id, o.case_id".replace("SELECT case_id, count", "SELECT c.id AS case_id, count").replace("list(option_id ORDER BY slot)", "list(option_id ORDER BY slot) FILTER (option_id IS NOT NULL)"), BOTH)
def _(s, d):
    table, opts = io.to_relational(views.cases_with_options(s, d), 1)
    return io.from_relational(table, opts).select("case_id", F.size("options").cast("long").alias("n"), F.array_join(F.transform("options", lambda o: o["id"]), "").alias("ids"))


@query("IO07_parity", "SELECT count(*) FILTER (l.doc_id IS NOT NULL AND NOT truncated) AS equal, count(*) FILTER (l.doc_id IS NOT NULL AND truncated) AS different, count(*) FILTER (l.doc_id IS NULL) AS only_a, CAST(0 AS BIGINT) AS only_b FROM cases_v LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = case_id")
def _(s, d):
    a = views.cases(s, d)
    return io.parity(a, a.join(with_label(s, d), "case_id", "left_semi").withColumn("title", F.when(F.col("truncated"), "changed").otherwise(F.col("title"))))


@query("IO08_upsert", "SELECT case_id, CASE WHEN truncated THEN 'fixed' ELSE category END AS category FROM cases_v")
def _(s, d):
    base = views.cases(s, d).select("case_id", "category", "truncated")
    return io.upsert(base, base.where("truncated").withColumn("category", F.lit("fixed"))).select("case_id", "category")


@query("IO10_parse_results", """SELECT 'needs-review|x|' || conv_id || '-' || turn AS custom_id, CASE WHEN turn % 5 = 4 THEN NULL ELSE chr(CAST(65 + turn % 4 AS INTEGER)) END AS option, CASE turn % 5 WHEN 3 THEN 'bad_confidence' WHEN 4 THEN 'empty_content' ELSE '' END AS error FROM conversations""".replace("FROM conversations", "FROM conv_v"), ("conv_v AS (SELECT conv_id, turn FROM conversations)",))
def _(s, d):
    t = F.col("turn")
    body = F.to_json(F.struct(F.col("conv_id").cast("string").alias("_id"), F.expr("char(65 + turn % 4)").alias("correct_option_id"), F.when(t % 5 == 3, "SURE").otherwise("high").alias("confidence"), F.lit("because").alias("rationale")))
    fenced = F.when(t % 5 == 4, "").otherwise(F.concat(F.lit("Here: ```json\n"), body, F.lit("\n```")))
    chat_shape = F.to_json(F.struct(F.concat(F.lit("needs-review|x|"), "conv_id", F.lit("-"), "turn").alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(fenced.alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    lines = views.table(s, d, "conversations").select(chat_shape.alias("value"), F.lit("f").alias("file"))
    return io.parse_results(lines).select("custom_id", "option", "error")


@query("IO04_schema_gate", "SELECT case_id FROM cases_v WHERE length(question) >= 20 AND category IS NOT NULL")
def _(s, d):
    return io.schema_gate(views.cases(s, d), {"question": F.length("question") >= 20, "category": F.col("category").isNotNull()})[0].select("case_id")


@query("IO12_plan_sources", "SELECT source, CASE WHEN n % 3 = 0 THEN 0 ELSE n END AS resume_at FROM (SELECT source, count(*) AS n FROM cases_v GROUP BY source) WHERE n % 3 = 0 OR n % 2 = 0")
def _(s, d):
    n = views.cases(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    state = n.select("source", F.when(F.col("n") % 3 == 0, "old").otherwise("now").alias("etag"), F.when(F.col("n") % 2 == 0, "partial").otherwise("complete").alias("status"), F.col("n").alias("row_offset"))
    return io.plan_sources(n.select("source", F.lit("now").alias("etag")), state)


@query("PR02_cols_mcq", """SELECT case_id AS case_key, len(list_filter(o, lambda x: x <> '')) AS n, CASE WHEN o[1 + case_id % 4] <> '' THEN substring('ABCD', CAST(1 + case_id % 4 AS INTEGER), 1) ELSE '' END AS key FROM (SELECT case_id, list_transform([1, 2, 3, 4], lambda i: coalesce(trim(string_split(question, '.')[i]), '')) AS o FROM cases_v)""")
def _(s, d):
    parts = F.split("question", "\\.", -1)
    raw = views.cases(s, d).select(F.col("case_id").alias("case_key"), "question", *[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(("opa", "opb", "opc", "opd"))], (F.col("case_id") % 4).cast("int").alias("cop"))
    return parse.parse_cols_mcq(raw).select("case_key", F.size("options").cast("long").alias("n"), F.array_join(F.transform(F.filter("options", lambda o: o["is_correct"]), lambda o: o["id"]), "").alias("key"))


@query("PR10_publishable", "SELECT case_id FROM agg_v WHERE n_options >= 2 AND n_right > 0", AUDIT)
def _(s, d):
    return parse.publishable(views.cases_with_options(s, d)).select("case_id")


@query("PR15_append_new", f"""SELECT case_id FROM (SELECT case_id, k, row_number() OVER (PARTITION BY k ORDER BY case_id) AS rn FROM (SELECT case_id, substring({ALNUM.format('question')}, 1, 100) AS k FROM cases_v WHERE case_id NOT IN (SELECT doc_id FROM labels))) WHERE rn = 1 AND k NOT IN (SELECT substring({ALNUM.format('question')}, 1, 100) FROM cases_v WHERE case_id IN (SELECT doc_id FROM labels))""")
def _(s, d):
    c = views.cases(s, d).select("case_id", "pos", "question")
    return parse.append_new(c.join(with_label(s, d), "case_id", "left_semi"), c.join(with_label(s, d), "case_id", "left_anti")).select("case_id")


@query("PR16_by_hits", "SELECT case_id, CASE WHEN greatest(a, b) = 0 THEN 'none' WHEN a >= b THEN 'en' ELSE 'de' END AS category FROM (SELECT case_id, CAST(contains(lower(question), ' the ') AS INTEGER) + CAST(contains(lower(question), ' of ') AS INTEGER) AS a, CAST(contains(lower(question), ' die ') AS INTEGER) + CAST(contains(lower(question), ' der ') AS INTEGER) AS b FROM cases_v)")
def _(s, d):
    return views.cases(s, d).select("case_id", parse.categorize_by_hits(F.col("question"), {"en": [" the ", " of "], "de": [" die ", " der "]}, "none").alias("category"))


@query("FN12_quality_score", """SELECT case_id, 25 * CAST(n_right > 0 AS INTEGER) + 25 * CAST(length(rationale) > 50 AS INTEGER) + 15 * CAST(NOT truncated AS INTEGER) + 10 * CAST(n_options BETWEEN 4 AND 5 AS INTEGER) + 10 * CAST(length(question) > 100 AS INTEGER) + 5 * CAST(NOT needs_review AS INTEGER) AS quality FROM agg_v""", AUDIT)
def _(s, d):
    score = scoring.quality_score(F.exists("options", lambda o: o["is_correct"]), F.col("rationale"), F.col("truncated"), F.size("options"), F.col("question"), F.lit(False), F.lit(False), F.col("needs_review"))
    return views.cases_with_options(s, d).select("case_id", score.alias("quality"))


@query("FN21_retrievability", "SELECT case_id, round(least(1, greatest(0, pow(1 + (pow(0.9, -2) - 1) * difficulty / (1 + score), -0.5))), 9) AS recall FROM cases_v")
def _(s, d):
    return views.cases(s, d).select("case_id", F.round(scoring.retrievability(1 + F.col("score"), F.col("difficulty")), 9).alias("recall"))


@query("FN16_resolve_option")
def _(s, d):
    said = F.element_at(F.array(F.lit("A"), F.lit("opb"), F.lit("3"), F.lit("zz")), (F.col("case_id") % 4 + 1).cast("int"))
    return views.cases_with_options(s, d).select("case_id", scoring.resolve_option(F.col("options"), said).alias("option"))
