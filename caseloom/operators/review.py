"""Applying reviewed results, edits and verdicts to the bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable
from .ids import dense_numbers


def merge_verdicts(results: DataFrame) -> DataFrame:
    """EN06: results (case_id, option, confidence, file) to one verdict a case.

    Only HIGH counts: one distinct option applies (from the first file), several
    are a conflict, none leaves the case in review.
    """
    high = F.when(F.col("confidence") == "HIGH", F.upper("option"))
    got = results.groupBy("case_id").agg(F.count_distinct(high).alias("n"), F.min(high).alias("option"), F.min(F.when(high.isNotNull(), F.col("file"))).alias("file"))
    action = F.when(F.col("n") == 0, "keep_review").when(F.col("n") == 1, "apply").otherwise("conflict")
    return got.select("case_id", action.alias("action"), F.when(F.col("n") == 1, F.col("option")).alias("option"), F.when(F.col("n") == 1, F.col("file")).alias("file"))


def apply_results(results: DataFrame) -> DataFrame:
    """EN07: per case the rationale and key that stand: full rationales over answer fixes over plain explanations; the later wins within a level.

    ``results`` has case_id, pos, full_rationale, answer, explanation.
    """
    level = F.when(F.col("full_rationale").isNotNull(), 3).when(F.col("answer").isNotNull(), 2).when(F.col("explanation").isNotNull(), 1)
    ranked = results.withColumn("level", level).where("level is not null")
    text = F.coalesce("full_rationale", "explanation")
    return ranked.groupBy("case_id").agg(
        F.max_by(text, F.when(text.isNotNull(), F.struct((F.col("level") == 3).alias("full"), "pos"))).alias("rationale"),
        F.max_by("answer", F.when(F.col("level") == 2, F.col("pos"))).alias("new_key"),
        F.max("level").alias("level"),
    )


def aligned(a: Column, b: Column) -> Column:
    """EN08: one normal text holds the other (24 characters at least), or 60 % of the fewer tokens are shared."""
    x, y = comparable(a), comparable(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    tokens = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: w != ""))
    fewer = F.least(F.size(tokens(x)), F.size(tokens(y)))
    shared = F.size(F.array_intersect(tokens(x), tokens(y)))
    return ((F.length(short) >= 24) & long.contains(short)) | ((fewer > 0) & (shared >= 0.6 * fewer))


def apply_answer_audit(options: DataFrame, audit: DataFrame) -> DataFrame:
    """EN09: HIGH makes its option the only right one; MEDIUM adds its option; others change nothing."""
    joined = options.join(audit.select("case_id", F.col("option").alias("_o"), F.col("confidence").alias("_c")), "case_id", "left")
    hit = F.col("option_id") == F.col("_o")
    out = F.when(F.col("_c") == "HIGH", hit).when((F.col("_c") == "MEDIUM") & hit, F.lit(True)).otherwise(F.col("is_correct"))
    return joined.withColumn("is_correct", out).drop("_o", "_c")


def blind_votes(answers: DataFrame, votes: DataFrame) -> DataFrame:
    """EN12: whether a blind vote's text equals the key's: agree or conflict."""
    joined = answers.join(votes, "case_id")
    return joined.select("case_id", F.when(comparable("answer") == comparable("vote"), "agree").otherwise("conflict").alias("outcome"))


def resolve_conflicts(df: DataFrame) -> DataFrame:
    """EN13: key from the audit where its quality is 80 or more; stale where the key agrees already."""
    state = F.when(F.col("key") == F.col("audit_key"), "stale").when(F.col("quality") >= 80, "flip").otherwise("hold")
    return df.select("case_id", state.alias("state"), F.when(state == "flip", F.col("audit_key")).otherwise(F.col("key")).alias("key"))


def current_values(edits: DataFrame, fields: list[str]) -> DataFrame:
    """EN15: latest value of each whitelisted field of each case, a column a field."""
    order = F.struct("created_at", "id")
    return edits.where(F.col("field").isin(*fields)).groupBy("case_id").agg(*[F.max_by("new_value", F.when(F.col("field") == f, order)).alias(f) for f in fields])


def patch_stats(outcomes: DataFrame) -> DataFrame:
    """AG24."""
    return outcomes.groupBy(F.col("action").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def unknown_cases(results: DataFrame, cases: DataFrame) -> DataFrame:
    """SE06: results whose case the bank does not have."""
    return results.join(cases.select("case_id"), "case_id", "left_anti")


def adjudicate(results: DataFrame, shortlist: DataFrame) -> DataFrame:
    """JN12: recommendations that the case's shortlist allows."""
    return results.join(shortlist, "case_id").where(F.array_contains("allowed", F.col("recommended"))).select("case_id", "recommended")


def number_packs(df: DataFrame, size: int) -> DataFrame:
    """WN10: file number of each row: packs of ``size`` within an issue type, by id; numbers come from ranges, so no issue is one task."""
    return dense_numbers(df, ["case_id"], "_n", ["issue"]).withColumn("pack", F.floor((F.col("_n") - 1) / F.lit(size))).drop("_n")


def conflict_lane(df: DataFrame) -> DataFrame:
    """SC10: lane of a held conflict: mechanical, answer_key or clinical, and whether it is a first-phase candidate."""
    lane = F.when(F.size("options") < 2, "mechanical").when(F.size(F.filter("options", lambda o: o["is_correct"])) != 1, "answer_key").otherwise("clinical")
    return df.where("status = 'QUARANTINED_AI_CONFLICT'").select("case_id", lane.alias("lane"), ((lane == "answer_key") & (F.col("score") >= 80)).alias("phase_1"))


def recover_rationale(df: DataFrame, fields: list[str], placeholder: str) -> DataFrame:
    """EN04: the longest text among ``fields`` that is no placeholder; the first of equals."""
    made = F.array(*[F.struct(F.length(F.trim(f)).alias("n"), F.lit(-k).alias("k"), F.trim(F.col(f)).alias("t")) for k, f in enumerate(fields)])
    good = F.filter(made, lambda x: x["t"].isNotNull() & (x["n"] > 0) & ~F.lower(x["t"]).rlike(placeholder))
    return df.select("case_id", F.array_max(good)["t"].alias("rationale")).where("rationale is not null")


def panel_cases(results: DataFrame) -> DataFrame:
    """EN16: five-point panel items from votes (case_id, votes array<int>): rescaled to 15 where the total is outside 10 to 20; the peak is the key."""
    total = F.aggregate("votes", F.lit(0), lambda a, v: a + v)
    scaled = F.when((total > 0) & ~total.between(10, 20), F.transform("votes", lambda v: F.floor(v * 15 / total + 0.5).cast("int"))).otherwise(F.col("votes"))
    return results.where((F.size("votes") == 5) & (total > 0)).select("case_id", scaled.alias("votes")).withColumn("peak", F.array_position("votes", F.array_max("votes")).cast("int"))
