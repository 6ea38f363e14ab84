"""Joining the bank with raw sources to check and repair answer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable


def fingerprints(options: DataFrame, chars: int = 30) -> DataFrame:
    """case_id and fp: sorted beginnings of its lower-cased option texts."""
    return options.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.substring(F.trim(F.lower("option_text")), 1, chars))), "|").alias("fp"))


def match_raw(bank: DataFrame, raw: DataFrame) -> DataFrame:
    """JN01: bank rows (case_id, fp) with the raw answer found by id, else by fingerprint; the last raw row wins.

    ``raw`` has case_id, fp, answer and pos. Both sides of the raw table are
    reduced to one row a key first, so no join multiplies rows.
    """
    by_id = raw.where("case_id is not null").groupBy("case_id").agg(F.max_by("answer", "pos").alias("by_id"))
    by_fp = raw.where("fp <> ''").groupBy("fp").agg(F.max_by("answer", "pos").alias("by_fp"))
    joined = bank.join(by_id, "case_id", "left").join(by_fp, "fp", "left")
    return joined.select("case_id", F.coalesce("by_id", "by_fp").alias("answer"), F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_fp").isNotNull(), "options").otherwise("none").alias("how"))


def heal_keys(bank: DataFrame, options: DataFrame, raw: DataFrame) -> DataFrame:
    """JN02: the raw answer becomes the key where raw rows of one fingerprint agree; otherwise a reason to hold the case.

    action: heal, keep (key is right already), ambiguous, all_of_above, absent, unmatched.
    """
    one = raw.groupBy("fp").agg(F.count_distinct(comparable("answer")).alias("n"), F.min(comparable("answer")).alias("answer"))
    texts = options.select("case_id", "option_id", "is_correct", comparable("option_text").alias("t"))
    joined = bank.join(one, "fp", "left")
    found = (
        joined.where("n = 1")
        .select("case_id", "answer")
        .join(texts, "case_id")
        .where("t = answer")
        .groupBy("case_id")
        .agg(F.min("option_id").alias("new_key"), F.max("is_correct").alias("already"))
    )
    broad = F.col("answer").rlike("^(all|none) of the above$")
    action = (
        F.when(F.col("n").isNull(), "unmatched")
        .when(F.col("n") > 1, "ambiguous")
        .when(broad, "all_of_above")
        .when(F.col("new_key").isNull(), "absent")
        .when(F.col("already"), "keep")
        .otherwise("heal")
    )
    return joined.join(found, "case_id", "left").select("case_id", action.alias("action"), F.when(action == "heal", F.col("new_key")).alias("new_key"))


def anchor_map(raw: DataFrame) -> DataFrame:
    """JN03: per full fingerprint the answer text and whether raw rows disagree."""
    return raw.groupBy("fp").agg(F.min("answer").alias("answer"), (F.count_distinct("answer") > 1).alias("ambiguous"))


def recover_questions(cases: DataFrame, bank: DataFrame, raw: DataFrame) -> DataFrame:
    """JN04: cases without a stem get that of the raw row with their options; the last raw row wins."""
    stems = raw.where("fp <> ''").groupBy("fp").agg(F.max_by("question", "pos").alias("found"))
    lost = cases.where(F.trim("question") == "").join(bank, "case_id").join(stems, "fp")
    return lost.select("case_id", F.col("found").alias("question"))


def anchor_fuzzy(options: DataFrame, anchors: DataFrame, most: int = 2, lead: int = 2) -> DataFrame:
    """JN06: the option that is an anchor text (case_id, anchor): equal and alone, or within ``most`` edits and clearly best."""
    dist = options.join(anchors, "case_id").withColumn("d", F.levenshtein(comparable("option_text"), comparable("anchor")))
    order = Window.partitionBy("case_id").orderBy("d", "slot")
    ranked = dist.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    pair = ranked.groupBy("case_id").agg(F.min_by("option_id", "rn").alias("option_id"), F.min("d").alias("d1"), F.max(F.when(F.col("rn") == 2, F.col("d"))).alias("d2"))
    clear = ((F.col("d1") == 0) & (F.coalesce("d2", F.lit(99)) > 0)) | ((F.col("d1") <= most) & (F.coalesce("d2", F.lit(99)) - F.col("d1") >= lead))
    return pair.where(clear).select("case_id", "option_id", F.col("d1").cast("long").alias("distance"))


def join_any_key(cases: DataFrame, patches: DataFrame) -> DataFrame:
    """JN07: patches (key, ...) joined with cases by any of their ids: an equi-join on exploded keys, no OR."""
    keyed = cases.select("case_id", F.explode(F.array_distinct(F.array(F.col("case_id").cast("string"), "hash_id", "case_code"))).alias("key")).where("key is not null")
    return keyed.join(patches, "key").dropDuplicates(["case_id", "key"])


def reverse_lookup(options: DataFrame, cases: DataFrame, least: int = 7) -> DataFrame:
    """JN09: for each wrong option, categories where one of its words is in a right option of another case.

    The right side is one row a word before the join; the first word by
    position wins, with at most two categories.
    """
    words = F.posexplode(F.array_distinct(F.filter(F.split(comparable("option_text"), " "), lambda w: F.length(w) >= least)))
    right = (
        options.where("is_correct")
        .select("case_id", words.alias("at", "word"))
        .join(cases.select("case_id", "category"), "case_id")
        .groupBy("word")
        .agg(F.slice(F.array_sort(F.collect_set("category")), 1, 2).alias("categories"), F.min("case_id").alias("lo"), F.max("case_id").alias("hi"))
    )
    wrong = options.where("not is_correct").select("case_id", "option_id", words.alias("at", "word"))
    hits = wrong.join(right, "word").where((F.col("lo") != F.col("case_id")) | (F.col("hi") != F.col("case_id")))
    return hits.groupBy("case_id", "option_id").agg(F.min(F.struct("at", "word", "categories")).alias("m")).select("case_id", "option_id", "m.word", F.array_join("m.categories", ",").alias("categories"))


def backfill(df: DataFrame, other: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """JN10: empty or null columns filled from another copy."""
    side = other.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in cols}
    return df.join(side, key, "left").withColumns(filled).drop(*[f"_{c}" for c in cols])


def apply_manifest(cases: DataFrame, manifest: DataFrame) -> DataFrame:
    """JN08: cases that the manifest does not hold back."""
    return cases.join(manifest.select("case_id"), "case_id", "left_anti")


def zip_ranked(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """JN13: the n-th row of one side with the n-th of the other."""
    from .ids import dense_numbers

    return dense_numbers(left, left_order, "_rank").join(dense_numbers(right, right_order, "_rank"), "_rank").drop("_rank")


def key_crosscheck(matched: DataFrame, answers: DataFrame) -> DataFrame:
    """AG22: share of matched cases whose key equals the raw answer; matched from :func:`match_raw`."""
    own = answers.groupBy("case_id").agg(F.min(comparable("answer")).alias("own"))
    both = matched.where("how <> 'none'").join(own, "case_id")
    return both.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("own") == comparable("answer")).alias("equal"))


def recover_keys_by_prefix(cases: DataFrame, bank: DataFrame, raw: DataFrame, chars: int = 60) -> DataFrame:
    """JN05: the raw answer of the same question beginning, else of the same options; two equi-joins, the first raw row wins.

    ``raw`` has question, fp, answer, pos; ``bank`` has case_id, fp.
    """
    head = lambda c: F.substring(comparable(c), 1, chars)
    by_head = raw.groupBy(head("question").alias("head")).agg(F.min_by("answer", "pos").alias("by_head"))
    by_fp = raw.where("fp <> ''").groupBy("fp").agg(F.min_by("answer", "pos").alias("by_fp"))
    joined = cases.select("case_id", head("question").alias("head")).join(by_head, "head", "left").join(bank, "case_id", "left").join(by_fp, "fp", "left")
    return joined.select("case_id", F.coalesce("by_head", "by_fp").alias("answer")).where("answer is not null")


def refill_stem(bank: DataFrame, raw: DataFrame) -> DataFrame:
    """JN14: stems by (year, fingerprint), else by fingerprint alone; the last raw row wins. bank has case_id, year, fp."""
    exact = raw.groupBy("year", "fp").agg(F.max_by("question", "pos").alias("exact"))
    loose = raw.groupBy("fp").agg(F.max_by("question", "pos").alias("loose"))
    joined = bank.join(exact, ["year", "fp"], "left").join(loose, "fp", "left")
    return joined.select("case_id", F.coalesce("exact", "loose").alias("question")).where("question is not null")
