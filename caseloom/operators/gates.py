"""Filters over cases and gates for what users send in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import is_playable, is_quarantined

# Tags and fields that users may send, and characters escaped in their texts.
TAGS = ("wrong_answer", "unclear", "incomplete", "bad_options", "bad_rationale", "duplicate", "excellent", "flagged")
FIELDS = ("prompt", "options", "rationale.correct", "rationale.pearl", "rationale.distractors", "answer_key", "vignette")
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def escape_text(c: Column, most: int) -> Column:
    out = F.coalesce(c, F.lit(""))
    for char, name in ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(name))
    return F.substring(F.trim(out), 1, most)


def feedback_gate(df: DataFrame, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """FL09: reports with a case and at least one known tag; texts escaped and cut."""
    known = F.array_intersect("tags", F.array(*[F.lit(t) for t in tags]))
    return df.withColumn("tags", known).where((F.size("tags") > 0) & F.col("case_id").isNotNull()).withColumn("comment", escape_text(F.col("comment"), 500)).withColumn("user_hash", escape_text(F.col("user_hash"), 64))


def proposal_gate(df: DataFrame, bans: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """FL10: proposals to known fields with a reference, of bounded size, of users not banned."""
    ok = F.col("field").isin(*fields) & (F.length(escape_text(F.col("reference"), 300)) >= 5) & F.col("new_value").isNotNull()
    small = (F.length(F.coalesce("old_value", F.lit(""))) <= 10_000) & (F.length("new_value") <= 10_000)
    return df.where(F.col("case_id").isNotNull() & ok & small).join(bans.select("user_hash"), "user_hash", "left_anti")


def browse(df: DataFrame, category: str | None = None, difficulty: int | None = None, exam: str | None = None, search: str | None = None, done: DataFrame | None = None, only_done: bool = False) -> DataFrame:
    """FL03: catalogue filter; an exam also shows BOTH; ``done`` is a set of case ids to show alone or leave out."""
    out = df
    if category:
        out = out.where(F.col("category") == category)
    if difficulty:
        out = out.where(F.col("difficulty") == difficulty)
    if exam:
        out = out.where(F.col("exam_type").isin(exam, "BOTH"))
    if search:
        out = out.where(F.lower(F.concat_ws(" ", "title", "question", "category")).contains(search.lower()))
    if done is not None:
        out = out.join(done.select("case_id").distinct(), "case_id", "left_semi" if only_done else "left_anti")
    return out


def exam_pool(df: DataFrame, exam: str, least_options: int = 4) -> DataFrame:
    """FL04: playable cases of an exam with one key and enough options."""
    one = F.size(F.filter("options", lambda o: o["is_correct"])) == 1
    return df.where(is_playable() & F.col("exam_type").isin(exam, "BOTH") & one & (F.size("options") >= least_options))


def flag_invalid(df: DataFrame) -> DataFrame:
    """FL07: cases without exactly one key that are not held yet."""
    return df.where(~is_quarantined() & (F.size(F.filter("options", lambda o: o["is_correct"])) != 1)).select("case_id")


def health_screen(df: DataFrame) -> DataFrame:
    """FL13: pass or hold."""
    ok = (F.size("options") >= 2) & (F.length(F.trim("question")) > 5) & F.exists("options", lambda o: o["is_correct"])
    return df.select("case_id", F.when(ok, "pass").otherwise("hold").alias("label"))


def panel_candidates(df: DataFrame, categories: list[str]) -> DataFrame:
    """FL14: keyed cases with a vignette and four options in the given categories, not held."""
    return df.where(~is_quarantined() & (F.length("narrative") >= 50) & (F.size("options") >= 4) & F.exists("options", lambda o: o["is_correct"]) & F.col("category").isin(*categories)).select("case_id")


def thin_rationale(df: DataFrame) -> DataFrame:
    """FL12: rationales under 80 characters or that only repeat the answer."""
    answer = F.lower(F.coalesce(F.get(F.filter("options", lambda o: o["is_correct"]), F.lit(0))["text"], F.lit("")))
    return df.where((F.length(F.trim("rationale")) < 80) | (F.lower(F.trim("rationale")) == answer)).select("case_id")
