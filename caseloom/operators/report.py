"""Counts, distributions and rankings of cases, reports and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, word_count


def is_quarantined() -> Column:
    """FL01: flagged, or a status that says so."""
    return F.coalesce(F.col("quarantined"), F.lit(False)) | F.coalesce(F.col("status").startswith("QUARANTINED"), F.lit(False))


def is_playable() -> Column:
    """FL02."""
    return ~is_quarantined() & ~F.coalesce(F.col("needs_review"), F.lit(False)) & ~F.coalesce(F.col("truncated"), F.lit(False))


def counts(df: DataFrame, by: list[str]) -> DataFrame:
    """AG01: counts by each column in one pass: dimension, value, n."""
    sets = ", ".join(f"({c})" for c in by)
    df.select(*[F.col(c).cast("string").alias(c) for c in by]).createOrReplaceTempView("_counted")
    which = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in by)
    value = f"coalesce({', '.join(by)})"
    return df.sparkSession.sql(f"SELECT CASE {which} END AS dimension, {value} AS value, count(*) AS n FROM _counted GROUP BY GROUPING SETS ({sets})")


def source_report(df: DataFrame) -> DataFrame:
    """AG02: per source: rows, rows with a rationale, mean of positive scores."""
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.length("rationale") > 10).alias("with_rationale"),
        F.round(F.avg(F.when(F.col("score") > 0, F.col("score"))), 4).alias("mean_score"),
    )


def confidence_hist(df: DataFrame) -> DataFrame:
    """AG03: four bands; missing counts as lowest."""
    c = F.coalesce("confidence", F.lit(0.0))
    return df.groupBy(F.when(c >= 4, "high").when(c >= 3, "medium").when(c >= 2, "low").otherwise("poor").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def quality_hist(df: DataFrame) -> DataFrame:
    """AG05: five ranges of score with their share in percent."""
    band = F.least(F.floor(F.col("score") / 20), F.lit(4)).cast("int")
    total = df.agg(F.count(F.lit(1)).alias("t"))
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("band", "n", F.round(F.col("n") * 100.0 / F.col("t"), 4).alias("share"))  # one row


def coverage(df: DataFrame, targets: dict[str, float]) -> DataFrame:
    """AG06: share of each category against its target: gap and verdict."""
    wanted = df.sparkSession.createDataFrame(list(targets.items()), "category string, target double")
    total = Window.partitionBy()
    got = df.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(wanted), "category", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(total), 1)
    gap = F.round(F.col("share") - F.coalesce("target", F.lit(0.0)), 1)
    return got.withColumn("share", share).withColumn("gap", gap).select("category", "n", "share", "gap", F.when(F.col("gap") < -3, "under").when(F.col("gap") > 5, "excess").otherwise("ok").alias("verdict"))


def bank_health(df: DataFrame) -> DataFrame:
    """AG19."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_playable()).alias("clean"), F.count_if(is_quarantined()).alias("held"), F.count_if("needs_review").alias("review"), F.count_if("truncated").alias("cut")
    )


def top_counts(df: DataFrame, by: str, k: int) -> DataFrame:
    """TK06: the ``k`` most frequent values, ties by value."""
    return df.groupBy(F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def length_stats(df: DataFrame, col: str) -> DataFrame:
    """AG14: exact order statistics of text lengths by group of equal lengths: value at index floor(n * p)."""
    sizes = df.groupBy(F.length(col).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    upto = sizes.withColumn("hi", F.sum("c").over(Window.orderBy("len")))  # one row for each distinct length
    total = sizes.agg(F.sum("c").alias("t"), F.min("len").alias("lo"), F.max("len").alias("top"), F.sum(F.col("len") * F.col("c")).alias("s"))
    at = lambda p, n: F.min(F.when(F.col("hi") > F.floor(F.col("t") * p), F.col("len"))).alias(n)
    return upto.crossJoin(F.broadcast(total)).groupBy("t", "lo", "top", "s").agg(at(0.25, "p25"), at(0.5, "median"), at(0.75, "p75")).select(
        F.col("t").alias("n"), F.col("lo").alias("shortest"), "p25", "median", "p75", F.col("top").alias("longest"), F.round(F.col("s") / F.col("t"), 4).alias("mean")
    )


def percentile_of_hist(hist: DataFrame, p: float) -> DataFrame:
    """WN07: the smallest value whose cumulative share reaches ``p``; hist has (value, n)."""
    order = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    run = hist.withColumn("cum", F.sum("n").over(order)).withColumn("t", F.sum("n").over(total))
    return run.where(F.col("cum") >= F.lit(p) * F.col("t")).agg(F.min("value").alias("value"))


def psychometrics(df: DataFrame) -> DataFrame:
    """AG12: how option lengths and positions give answers away; over cases with one correct option and others."""
    right, wrong = F.filter("options", lambda o: o["is_correct"]), F.filter("options", lambda o: ~o["is_correct"])
    absolute = "(?i)\\b(always|never|all|none|only)\\b"
    rows = df.where((F.size(right) == 1) & (F.size(wrong) > 0)).select(
        F.length(right[0]["text"]).alias("rl"),
        (F.aggregate(wrong, F.lit(0), lambda a, o: a + F.length(o["text"])) / F.size(wrong)).alias("wl"),
        right[0]["text"].rlike(absolute).alias("ra"),
        F.exists(wrong, lambda o: o["text"].rlike(absolute)).alias("wa"),
        right[0]["id"].alias("slot"),
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("rl"), 4).alias("mean_right"),
        F.round(F.avg("wl"), 4).alias("mean_wrong"),
        F.count_if(F.col("rl") > F.col("wl")).alias("right_longer"),
        F.count_if("ra").alias("absolute_right"),
        F.count_if("wa").alias("absolute_wrong"),
        *[F.count_if(F.col("slot") == s).alias(f"slot_{s.lower()}") for s in "ABCD"],
    )


def telemetry_gate(events: DataFrame) -> DataFrame:
    """FL08: answers with a case and a plausible time; user hashes cut to 64 characters."""
    return events.where(F.col("case_id").isNotNull() & F.col("time_ms").between(1500, 3_600_000)).withColumn("user_hash", F.substring("user_hash", 1, 64))


def first_answers(events: DataFrame) -> DataFrame:
    """ST01, batch form: the first accepted answer of each (case, user)."""
    order = F.struct("ts", "event_id")
    return telemetry_gate(events).groupBy("case_id", "user_hash").agg(F.min_by("is_correct", order).alias("is_correct"), F.min_by("time_ms", order).alias("time_ms"), F.min(order)["event_id"].alias("event_id"))


def item_stats(events: DataFrame) -> DataFrame:
    """ST02: per case: accepted first answers, accuracy and mean time."""
    return first_answers(events).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("is_correct").cast("int")), 4).alias("accuracy"), F.round(F.avg("time_ms"), 2).alias("mean_ms")
    )


def accuracy_by_category(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """AG20: percent right per category; weak below 70 with at least two answers."""
    got = answers.join(cases.select("case_id", "category"), "case_id").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_correct").cast("int")).alias("hits"))
    pct = F.floor(F.col("hits") * 100 / F.col("n") + 0.5)
    return got.withColumn("percent", pct).withColumn("area", F.when((F.col("percent") < 70) & (F.col("n") >= 2), "weak").otherwise("strong"))


def progress(cases: DataFrame, done: DataFrame) -> DataFrame:
    """AG18: per category: cases and those a user has done (done: case_id)."""
    marks = done.select("case_id", F.lit(1).alias("d")).distinct()
    return cases.join(marks, "case_id", "left").groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count("d").alias("done"))


def feedback_counts(fb: DataFrame) -> DataFrame:
    """AG08."""
    return fb.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("open", "resolved", "dismissed")], F.count(F.lit(1)).alias("total"))


def top_flagged(fb: DataFrame, k: int) -> DataFrame:
    """AG09: cases with most tag rows: also distinct reports, tags, first and last time, open tag rows."""
    rows = fb.select("id", "case_id", "status", "created_at", F.explode("tags").alias("tag"))
    return (
        rows.groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("tag_rows"), F.count_distinct("id").alias("reports"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"),
            F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count_if(F.col("status") == "open").alias("open_rows"),
        )
        .orderBy(F.desc("tag_rows"), "case_id")
        .limit(k)
    )


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """TK01: newest first; the limit is held between 1 and 200."""
    return df.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(min(200, max(1, limit)))


def recent_strikes(edits: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """AG11: rejected edits of each user in the last days."""
    return edits.where(F.col("created_at") > now - F.expr(f"INTERVAL {days} DAYS")).groupBy("user_hash").agg(F.count(F.lit(1)).alias("strikes"))


def edits_since(edits: DataFrame, since: Column) -> DataFrame:
    """TK07: edited cases since a time, newest first."""
    return edits.where(F.col("created_at") >= since).groupBy("case_id").agg(F.max("created_at").alias("last_at")).orderBy(F.desc("last_at"), "case_id")


def streaks(answers: DataFrame) -> DataFrame:
    """WN08: runs of consecutive days with an answer: user, first day, days."""
    days = answers.select("user_hash", F.to_date("ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_hash").orderBy("day")))
    return days.withColumn("island", island).groupBy("user_hash", "island").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days")).drop("island")


def daily_order(cases: DataFrame, day: str, done: DataFrame) -> DataFrame:
    """TK04: a shuffle that is stable for a day, unseen cases first."""
    marks = done.select("case_id", F.lit(True).alias("seen")).distinct()
    return cases.join(marks, "case_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False))).orderBy("seen", F.xxhash64("case_id", F.lit(day)), "case_id")


def sample_exam(cases: DataFrame, n: int, seed: int) -> DataFrame:
    """TK05: ``n`` cases in the order of the SHA-256 of seed, bar and id."""
    return cases.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "case_id"), 256), "case_id").limit(n)


def best_finding(findings: DataFrame, weights: dict[str, int]) -> DataFrame:
    """WN05: per case the finding of most weight; the first wins ties. findings: case_id, pos, level, code."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("level")], F.lit(0))
    return findings.groupBy("case_id").agg(F.max_by(F.struct("level", "code"), F.struct(weight, -F.col("pos"))).alias("b")).select("case_id", "b.level", "b.code")


def text_lengths(df: DataFrame) -> DataFrame:
    """FN13: length bucket, number of words, negative stem."""
    n = word_count("question")
    negative = comparable("question").rlike("\\b(not|except|nicht|pas|sauf|no)\\b")
    return df.select("case_id", n.cast("long").alias("words"), F.when(n <= 50, "short").when(n <= 150, "medium").otherwise("long").alias("bucket"), negative.alias("negative_stem"))


def cap_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """WN11: rows of the ``n`` groups that are seen first, by their smallest pos; a report's cap, not a sample."""
    first = df.groupBy(group).agg(F.min("pos").alias("_first")).orderBy("_first", group).limit(n).select(group)
    return df.join(first, group, "left_semi")
