"""Queries that run a stream over a test table in several arrivals, and the tables it keeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scoring import DECAY, FACTOR, MEMORY_W
from ..operators import memory
from ..sources.versions import Versions
from ..streaming import cards, kept
from . import views
from .queries import FIRST, ORACLE_SQL, RESULTS_SQL, VERDICTS, query, review_log
from .source_queries import folder
from .views import CASES_SQL, FEEDBACK_SQL, TELEMETRY_SQL

LIMIT = 5


def in_arrivals(rows: DataFrame, arrival: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Append the rows to a folder, one arrival (0, 1, 2) after the other, and run the stream after each."""
    spark = rows.sparkSession
    path = folder(spark, "arrivals")
    columns = [c for c in rows.columns if c != arrival]
    for k in range(3):
        rows.where(F.col(arrival) == k).select(*columns).write.mode("append").parquet(path)
        start(spark.readStream.schema(rows.select(*columns).schema).parquet(path)).awaitTermination()


def arrival() -> Column:
    """Ten days an arrival; every tenth event comes one arrival late."""
    return F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10) + F.when(F.col("seq") % 10 == 0, 1).otherwise(0)).cast("int")


def _n(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


_w = [_n(x) for x in MEMORY_W]
_D = f"greatest(1, least(10, f.d - {_w[6]} * {_w[7]} * (l.g - 3)))"
_R = f"pow(1 + {_n(FACTOR)} * (l.sec - f.sec) / 86400 / f.s, {_n(DECAY)})"
#: The fold of reviews as a recursion, card by card.
FOLDED = f"""log_v AS (SELECT user_hash, case_id, CAST(1 + event_id % 4 AS INTEGER) AS g, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_hash, case_id ORDER BY ts, event_id) AS r FROM telemetry_v WHERE case_id IS NOT NULL),
  cards_v AS (WITH RECURSIVE fold_v AS (
    SELECT user_hash, case_id, r, greatest(1, least(10, {_w[4]} - (g - 3) * {_w[5]})) AS d, [{', '.join(_w[:4])}][g] AS s, 0 AS lapses, sec FROM log_v WHERE r = 1
    UNION ALL SELECT l.user_hash, l.case_id, l.r, {_D}, CASE WHEN l.g >= 3 THEN f.s * (1 + exp({_w[8]}) * (11 - {_D}) * pow(f.s, -{_w[9]}) * (exp({_w[10]} * (1 - {_R})) - 1))
      ELSE greatest(0.1, {_w[11]} * pow({_D}, -{_w[12]}) * (pow(f.s + 1, {_w[13]}) - 1) * exp({_w[14]} * (1 - {_R}))) END, f.lapses + CASE WHEN l.g < 3 THEN 1 ELSE 0 END, l.sec
    FROM fold_v f JOIN log_v l ON l.user_hash = f.user_hash AND l.case_id = f.case_id AND l.r = f.r + 1)
    SELECT user_hash, case_id, max(r) AS reviews, arg_max(d, r) AS difficulty, arg_max(s, r) AS stability, arg_max(lapses, r) AS lapses, arg_max(sec, r) AS last_review FROM fold_v GROUP BY user_hash, case_id)"""
_STATES = "SELECT user_hash, case_id, round(difficulty, 6) AS difficulty, round(stability, 6) AS stability, round(last_review, 6) AS last_review, lapses, reviews FROM cards_v"
ORACLE_SQL["ST03_fold_reviews"] = f"WITH {TELEMETRY_SQL}, {FOLDED} {_STATES}"
_NOW = "CAST(1710000000.0 AS DOUBLE)"
_RECALL = f"pow(1 + {_n(FACTOR)} * (({_NOW} - last_review) / 86400) / stability, {_n(DECAY)})"
ORACLE_SQL["ST04_reset_corrected"] = f"""WITH {CASES_SQL}, {TELEMETRY_SQL}, {FOLDED} SELECT user_hash, c.case_id, CASE WHEN q THEN 5.0 ELSE round(difficulty, 6) END AS difficulty, CASE WHEN q THEN 0.0 ELSE round(stability, 6) END AS stability,
  CASE WHEN q THEN 0 ELSE lapses END AS lapses, CASE WHEN q THEN 0.0 ELSE round(last_review, 6) END AS last_review, reviews FROM cards_v c LEFT JOIN (SELECT case_id, true AS q FROM cases_v WHERE quarantined) x ON x.case_id = c.case_id"""
ORACLE_SQL["ST05_memory_stats"] = f"""WITH {TELEMETRY_SQL}, {FOLDED} SELECT user_hash, reviewed, CAST(floor(m * 100 + 0.5) AS BIGINT) AS retention, lapses, CASE WHEN m > 0.85 THEN 'Strong' WHEN m > 0.6 THEN 'Moderate' ELSE 'Weak' END AS strength
  FROM (SELECT user_hash, count(*) AS reviewed, avg({_RECALL}) AS m, CAST(sum(lapses) AS BIGINT) AS lapses FROM cards_v GROUP BY user_hash)"""
ORACLE_SQL["TK03_due_cards"] = f"""WITH {TELEMETRY_SQL}, {FOLDED} SELECT user_hash, case_id, round(p, 6) AS retrievability, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_hash ORDER BY p, case_id) AS INTEGER) AS place FROM (SELECT user_hash, case_id, {_RECALL} AS p FROM cards_v) WHERE p < 0.9) WHERE place <= 20"""


@query("WN09_stream_cards", _STATES, (TELEMETRY_SQL, FOLDED))
def _(s, d):
    """ST03 as a stream with keyed state: late reviews are folded where they belong."""
    tables = Versions(s, folder(s, "cards"), {"cards": ["user_hash", "case_id"]})
    checkpoint = folder(s, "cards-checkpoint")
    in_arrivals(review_log(s, d).withColumn("arrival", arrival()), "arrival", lambda log: cards.keep_cards(log, tables, checkpoint, "30 days"))
    return tables.read("cards").select("user_hash", "case_id", *[F.round(c, 6).alias(c) for c in ("difficulty", "stability", "last_review")], "lapses", "reviews")


@query("ST02_stream_stats", "SELECT case_id, count(*) AS n, round(avg(CAST(is_correct AS INTEGER)), 4) AS accuracy, round(avg(time_ms), 2) AS mean_ms FROM first_v GROUP BY case_id", (TELEMETRY_SQL, FIRST))
def _(s, d):
    """Item statistics kept by a stream, with late answers that replace kept ones."""
    tables = Versions(s, folder(s, "items"), kept.ITEM_KEYS)
    checkpoint = folder(s, "items-checkpoint")
    in_arrivals(views.telemetry(s, d).withColumn("seq", F.col("event_id")).withColumn("arrival", arrival()), "arrival", lambda events: kept.keep_item_stats(events, tables, checkpoint))
    return kept.item_stats_now(tables)


@query("ST06_results_once", f"""SELECT v.case_id, action, option, file, rationale, CASE WHEN level = 3 THEN NULL ELSE new_key END AS new_key, level FROM ({VERDICTS}) v JOIN (
  SELECT case_id, CASE WHEN max(l) = 3 THEN arg_max(text, pos) FILTER (l = 3) ELSE arg_max(text, pos) FILTER (l = 1) END AS rationale, arg_max(option, pos) FILTER (l = 2) AS new_key, max(l) AS level
  FROM (SELECT case_id, pos, option, nullif(text, '') AS text, CASE WHEN pos % 4 = 1 AND text <> '' THEN 3 WHEN pos % 2 = 0 THEN 2 WHEN text <> '' THEN 1 END AS l FROM results_v) GROUP BY case_id) e ON e.case_id = v.case_id""", (RESULTS_SQL,))
def _(s, d):
    """Result lines made from conversations, in three arrivals: turns decide whether a line has a rationale, an answer or an explanation."""
    t = F.col("turn")
    letter = F.when((F.col("conv_id") + F.floor(t / 2)) % 2 == 0, "A").otherwise("B")
    body = F.to_json(F.struct(
        F.col("conv_id").cast("string").alias("_id"), letter.alias("correct_option_id"), F.when(t % 3 == 0, "high").when(t % 3 == 1, "MEDIUM").otherwise("LOW").alias("confidence"),
        F.when(t % 4 == 1, F.col("text")).alias("correct_rationale"), F.when(t % 2 == 0, letter).alias("resolved_answer"), F.when(t % 2 == 1, F.col("text")).alias("explanation"),
    ))
    choice = F.struct(F.struct(F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("content")).alias("message"))
    line = F.to_json(F.struct(F.struct(F.struct(F.array(choice).alias("choices")).alias("body")).alias("response")))
    lines = views.table(s, d, "conversations").select(line.alias("value"), F.concat(F.lit("f"), F.lpad(t.cast("string"), 4, "0")).alias("file"), t.alias("pos"), (t % 3).cast("int").alias("arrival"))
    tables = Versions(s, folder(s, "results"), kept.RESULT_KEYS)
    checkpoint = folder(s, "results-checkpoint")
    in_arrivals(lines, "arrival", lambda new: kept.keep_outcomes(kept.result_rows(new), tables, checkpoint))
    found = kept.outcomes(tables.read("outcomes"))
    return found.withColumn("new_key", F.when(F.col("level") == 3, F.lit(None)).otherwise(F.col("new_key")))


@query("ST07_ban_list", f"""SELECT user_hash, arg_max(n, k) AS strike_count, max(k) AS seen FROM (
  SELECT user_hash, k, count(*) AS n FROM feedback_v JOIN (SELECT DISTINCT a AS k, max(created_at) OVER (ORDER BY a) AS now FROM (SELECT *, least(2, (day(created_at) - 1) // 10) AS a FROM feedback_v WHERE list_contains(tags, 'error'))) ON created_at > now - INTERVAL 7 DAYS AND created_at <= now
  WHERE list_contains(tags, 'error') GROUP BY user_hash, k HAVING count(*) >= {LIMIT}) GROUP BY user_hash""", (FEEDBACK_SQL,))
def _(s, d):
    """Rejected edits in three arrivals, every seventh told twice: who had too many in the seven days before one of them ended."""
    edits = views.feedback(s, d).where(F.array_contains("tags", "error")).select("id", "user_hash", "created_at")
    edits = edits.unionByName(edits.where("id % 7 = 0")).withColumn("arrival", F.least(F.lit(2), F.floor((F.dayofmonth("created_at") - 1) / 10)).cast("int"))
    tables = Versions(s, folder(s, "bans"), kept.BAN_KEYS)
    checkpoint = folder(s, "bans-checkpoint")
    in_arrivals(edits, "arrival", lambda new: kept.keep_bans(new, tables, checkpoint, limit=LIMIT))
    seen = F.least(F.lit(2), F.floor((F.dayofmonth("at") - 1) / 10)).cast("long")
    return tables.read("bans").select("user_hash", "strike_count", seen.alias("seen"))
