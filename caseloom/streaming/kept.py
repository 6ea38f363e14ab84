"""Tables that streams keep up to date: item statistics (ST02), results applied once (ST06), the ban list (ST07).

Each batch becomes one version of its tables together with its number
(``sources.versions``): whatever a replayed batch or a crash repeats, its rows
count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.report import telemetry_gate
from ..sources.io import parse_results
from ..sources.versions import Versions

ITEM_KEYS = {"first": ["case_id", "user_hash"], "stats": ["case_id"]}
RESULT_KEYS = {"outcomes": ["case_id"]}
BAN_KEYS = {"strikes": ["id"], "bans": ["user_hash"]}


def _run(df: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _beside(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Full join of old and new rows by key, columns prefixed ``o_`` and ``n_``."""
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    return _named(old, "o_").join(_named(new, "n_"), on, "full_outer")


def keep_item_stats(events: DataFrame, tables: Versions, checkpoint: str) -> StreamingQuery:
    """ST02: per case the accepted first answers, those that are right, and their time, after every batch as the batch form has them.

    A batch is reduced to its first answers and joined with the buckets of the
    kept ones. Only what changes moves the sums: a new answer is added, and one
    that turns out to be earlier takes the place of the kept one.
    """
    order = lambda p: F.struct(F.col(f"{p}ts"), F.col(f"{p}event_id"))

    def write(batch: DataFrame, epoch: int) -> None:
        if not tables.due(tables.state(), ("items", epoch)):
            return
        answer = F.min_by(F.struct(F.col("is_correct").cast("int").alias("hit"), F.col("time_ms").cast("long").alias("ms")), F.struct("ts", "event_id"))
        new = telemetry_gate(batch).where("user_hash is not null").groupBy("case_id", "user_hash").agg(answer.alias("a"), F.min(F.struct("ts", "event_id")).alias("at"))
        new = new.select("case_id", "user_hash", "a.hit", "a.ms", "at.ts", "at.event_id").persist()
        old = tables.read("first")
        old = new.limit(0) if old is None else old
        both = new.alias("n").join(_named(old, "o_"), (F.col("case_id") == F.col("o_case_id")) & (F.col("user_hash") == F.col("o_user_hash")), "left")
        changed = both.where(F.col("o_case_id").isNull() | (order("") < order("o_")))
        less = lambda c: F.col(c) - F.coalesce(f"o_{c}", F.lit(0))
        moved = changed.groupBy("case_id").agg(F.count_if(F.col("o_case_id").isNull()).alias("n"), F.sum(less("hit")).alias("hits"), F.sum(less("ms")).alias("ms"))

        def earlier(kept: DataFrame, delta: DataFrame) -> DataFrame:
            pair = _beside(kept, delta, ITEM_KEYS["first"])
            takes = F.col("o_case_id").isNull() | (F.col("n_case_id").isNotNull() & (order("n_") < order("o_")))
            return pair.select(*[F.when(takes, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in kept.columns])

        def added(kept: DataFrame, delta: DataFrame) -> DataFrame:
            sums = [(F.coalesce(f"o_{c}", F.lit(0)) + F.coalesce(f"n_{c}", F.lit(0))).cast("long").alias(c) for c in ("n", "hits", "ms")]
            return _beside(kept, delta, ["case_id"]).select(F.coalesce("o_case_id", "n_case_id").alias("case_id"), *sums)

        tables.upsert({"first": new, "stats": moved}, ("items", epoch), {"first": earlier, "stats": added})
        new.unpersist()

    return _run(events, write, checkpoint)


def item_stats_now(tables: Versions, version: int | None = None) -> DataFrame:
    """The columns of the batch form of ST02."""
    mean = lambda c, digits: F.round(F.col(c) / F.col("n"), digits)
    return tables.read("stats", version).select("case_id", "n", mean("hits", 4).alias("accuracy"), mean("ms", 2).alias("mean_ms"))


def _facts(results: DataFrame) -> DataFrame:
    """What results (case_id, pos, file, option, confidence, full_rationale, answer, explanation) say of each case, in a form that adds up.

    high: the distinct options of confidence HIGH, of which three tell as much
    as all; file: the first that names one; full and plain: the last text of
    either level with its place; fix: the last answer of level 2.
    """
    high = F.when(F.col("confidence") == "HIGH", F.upper("option"))
    full = F.col("full_rationale").isNotNull()
    fix = ~full & F.col("answer").isNotNull()
    said = lambda c, when: F.max(F.when(when & F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("text"))))
    return results.groupBy("case_id").agg(
        F.min(high).alias("low_option"),
        F.max(high).alias("high_option"),
        F.min(F.when(high.isNotNull(), F.col("file"))).alias("file"),
        said("full_rationale", full).alias("full"),
        said("explanation", ~full).alias("plain"),
        said("answer", fix).alias("fix"),
        F.max(F.when(full, 3).when(fix, 2).when(F.col("explanation").isNotNull(), 1)).alias("level"),
    )


def _add_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    least, most = {"low_option", "file"}, {"high_option", "full", "plain", "fix", "level"}
    joined = _beside(old, new, ["case_id"])
    pick = lambda c: (F.array_min if c in least else F.array_max)(F.array(f"o_{c}", f"n_{c}"))
    return joined.select(F.coalesce("o_case_id", "n_case_id").alias("case_id"), *[pick(c).alias(c) for c in old.columns if c in least | most])


def outcomes(facts: DataFrame) -> DataFrame:
    """EN06 and EN07 of all results so far: action, option and file of the verdict; rationale, new key and level that stand."""
    action = F.when(F.col("low_option").isNull(), "keep_review").when(F.col("low_option") == F.col("high_option"), "apply").otherwise("conflict")
    applies = action == "apply"
    return facts.select(
        "case_id",
        action.alias("action"),
        F.when(applies, F.col("low_option")).alias("option"),
        F.when(applies, F.col("file")).alias("file"),
        F.coalesce("full.text", "plain.text").alias("rationale"),
        F.col("fix.text").alias("new_key"),
        "level",
    )


RESULT_BODY = "_id string, correct_option_id string, confidence string, correct_rationale string, resolved_answer string, explanation string"


def result_rows(lines: DataFrame) -> DataFrame:
    """Rows for :func:`keep_outcomes` from lines (value, file, pos): those that parse and name a case."""
    content = F.get_json_object("value", "$.response.body.choices[0].message.content")
    body = F.from_json(F.regexp_extract(F.regexp_replace(F.coalesce(content, F.lit("")), "```(json)?", ""), "(?s)(\\{.*\\})", 1), RESULT_BODY)
    filled = lambda c: F.nullif(F.col(f"b.{c}"), F.lit(""))
    return lines.withColumn("b", body).select(
        F.try_to_number(F.col("b._id"), F.lit("999999999999999")).cast("long").alias("case_id"), F.col("pos").cast("long").alias("pos"), "file", filled("correct_option_id").alias("option"), F.upper("b.confidence").alias("confidence"),
        filled("correct_rationale").alias("full_rationale"), filled("resolved_answer").alias("answer"), filled("explanation").alias("explanation"),
    ).where("case_id is not null")


def keep_outcomes(results: DataFrame, tables: Versions, checkpoint: str) -> StreamingQuery:
    """ST06: results as they arrive, applied once to the table ``outcomes`` (read by :func:`outcomes`)."""

    def write(batch: DataFrame, epoch: int) -> None:
        tables.upsert({"outcomes": _facts(batch)}, ("results", epoch), {"outcomes": _add_facts})

    return _run(results, write, checkpoint)


def keep_bans(edits: DataFrame, tables: Versions, checkpoint: str, limit: int = 3, days: int = 7, late: str = "1 day") -> StreamingQuery:
    """ST07: users with ``limit`` rejected edits or more in the last ``days``, put on or replaced in the table ``bans``.

    ``edits`` are rejected edits (id, user_hash, created_at); one that is told
    twice within ``late`` counts once. The days end with the newest edit seen.
    Edits are kept by id, not by user, as long as they can count; a ban stays.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        state = tables.state()
        if not tables.due(state, ("edits", epoch)):
            return
        kept = tables.read("strikes", state["version"]) if "strikes" in state["tables"] else batch.limit(0)
        rows = batch.persist()
        now = kept.select("created_at").unionByName(rows.select("created_at")).agg(F.max("created_at")).first()[0]
        recent = F.col("created_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
        seen = kept.join(rows.select("id"), "id", "left_anti").select(*rows.columns).unionByName(rows).where(recent)
        banned = seen.groupBy("user_hash").agg(F.count(F.lit(1)).alias("strike_count")).where(F.col("strike_count") >= limit).select("user_hash", F.lit("rejected edits").alias("reason"), "strike_count", F.lit(now).cast("timestamp").alias("at"))
        tables.upsert({"strikes": rows.where(recent), "bans": banned}, ("edits", epoch), {"strikes": lambda old, new: old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(new).where(recent)})
        rows.unpersist()

    good = edits.where("id is not null and user_hash is not null").select("id", "user_hash", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", late)
    return _run(good.dropDuplicatesWithinWatermark(["id"]), write, checkpoint)
