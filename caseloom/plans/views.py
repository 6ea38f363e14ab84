"""Case tables derived from the test tables, in Spark and in the SQL of the oracle.

The library itself knows only case frames; these views are how its operators
are tried on data without exam questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; one that comes as fewer pieces than there are cores (a small file) is spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: a case without options. Its title is the first sentence, its rationale all after it (all of a text of one)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    return docs.join(labels, "doc_id", "left").select(
        i.alias("case_id"),
        i.alias("pos"),
        "source",
        F.col("lang").alias("category"),
        F.when(i % 3 == 0, "A").when(i % 3 == 1, "B").otherwise("BOTH").alias("exam_type"),
        text.alias("question"),
        text.alias("narrative"),
        F.substring_index(text, ".", 1).alias("title"),
        F.substr(text, F.instr(text, ".") + 1).alias("rationale"),
        F.when(i % 11 != 0, (1 + (i * 7) % 5).cast("double")).alias("confidence"),
        ((i * 13) % 101).cast("double").alias("score"),
        (1 + i % 5).cast("int").alias("difficulty"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("quarantined"),
        (F.coalesce("quality", F.lit(1)) == 0).alias("needs_review"),
        (i % 17 == 0).alias("truncated"),
        F.when(F.col("toxic") == 1, "QUARANTINED_TOXIC").when(i % 19 == 0, "QUARANTINED_AI_CONFLICT").otherwise("OK").alias("status"),
    )


CASES_SQL = """cases_v AS (
  SELECT doc_id AS case_id, doc_id AS pos, source, lang AS category,
    CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'BOTH' END AS exam_type,
    coalesce(text, '') AS question, coalesce(text, '') AS narrative, split_part(coalesce(text, ''), '.', 1) AS title,
    substring(coalesce(text, ''), instr(coalesce(text, ''), '.') + 1) AS rationale,
    CASE WHEN doc_id % 11 <> 0 THEN CAST(1 + (doc_id * 7) % 5 AS DOUBLE) END AS confidence,
    CAST((doc_id * 13) % 101 AS DOUBLE) AS score, CAST(1 + doc_id % 5 AS INTEGER) AS difficulty,
    coalesce(toxic, 0) = 1 AS quarantined, coalesce(quality, 1) = 0 AS needs_review, doc_id % 17 = 0 AS truncated,
    CASE WHEN toxic = 1 THEN 'QUARANTINED_TOXIC' WHEN doc_id % 19 = 0 THEN 'QUARANTINED_AI_CONFLICT' ELSE 'OK' END AS status
  FROM documents LEFT JOIN labels USING (doc_id))"""


def options(cases_df: DataFrame) -> DataFrame:
    """The first four sentences of a case as its options A to D."""
    parts = F.slice(F.split("question", "\\.", -1), 1, 4)
    return (
        cases_df.select("case_id", "pos", "source", F.posexplode(parts).alias("i", "t"))
        .select(
            "case_id",
            "pos",
            "source",
            (F.col("i") + 1).cast("long").alias("slot"),
            F.substring(F.lit("ABCD"), F.col("i") + 1, F.lit(1)).alias("option_id"),
            trimmed("t").alias("option_text"),
            (F.col("i") == F.col("case_id") % 4).alias("is_correct"),
        )
        .where("option_text <> ''")
    )


OPTIONS_SQL = """options_v AS (
  SELECT case_id, pos, source, CAST(i AS BIGINT) AS slot, substring('ABCD', CAST(i AS INTEGER), 1) AS option_id, trim(parts[i]) AS option_text, i - 1 = case_id % 4 AS is_correct
  FROM (SELECT case_id, pos, source, parts, unnest(range(1, least(len(parts), 4) + 1)) AS i FROM (SELECT case_id, pos, source, string_split(question, '.') AS parts FROM cases_v))
  WHERE trim(parts[i]) <> '')"""


def cases_with_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with ``options`` array<struct<id, text, is_correct>> made in the row, in slot order."""
    frame = cases(spark, sf_dir)
    parts = F.slice(F.split("question", "\\.", -1), 1, 4)
    made = F.transform(
        parts,
        lambda t, i: F.struct(F.substring(F.lit("ABCD"), i + 1, F.lit(1)).alias("id"), trimmed(t).alias("text"), (i == F.col("case_id") % 4).alias("is_correct")),
    )
    return frame.withColumn("options", F.filter(made, lambda o: o["text"] != ""))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: events with a case, a user and a time."""
    case = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", case.alias("case_id"), F.col("user_id").cast("string").alias("user_hash"), (F.col("event_id") % 3 == 0).alias("is_correct"),
        (F.col("event_id") * 37 % 4000000).alias("time_ms"), "ts", "event_type",
    )


TELEMETRY_SQL = """telemetry_v AS (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS case_id, CAST(user_id AS VARCHAR) AS user_hash, event_id % 3 = 0 AS is_correct,
    event_id * 37 % 4000000 AS time_ms, ts, event_type FROM events)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports: events as feedback with one or two tags and a status."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), k.alias("case_id"),
        F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("typo"))).otherwise(F.array("event_type")).alias("tags"),
        F.when(k % 3 == 0, "open").when(k % 3 == 1, "resolved").otherwise("dismissed").alias("status"),
        F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("user_hash"),
    )


FEEDBACK_SQL = """feedback_v AS (
  SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS case_id,
    CASE WHEN event_id % 2 = 0 THEN [event_type, 'typo'] ELSE [event_type] END AS tags,
    CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'dismissed' END AS status,
    ts AS created_at, CAST(user_id AS VARCHAR) AS user_hash FROM events)"""
