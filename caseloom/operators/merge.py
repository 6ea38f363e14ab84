"""Golden records: clusters of one question become one record (DD03 to DD06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signature import options_hash, semantic_sig
from ..sources.io import ensure_checkpoint_dir


def merge_keys(cases: DataFrame) -> DataFrame:
    """case_id, pos and merge_key; rows without a signature are clusters of their own.

    In a cluster that has both exam contexts A and B, A and BOTH merge and B
    stays apart; otherwise all merge.
    """
    sig = semantic_sig(F.col("question"))
    narrow = cases.select("case_id", "pos", "source", "exam_type", "confidence", sig.alias("sig"), options_hash(F.transform("options", lambda o: o["text"])).alias("oh"))
    cluster = F.concat_ws("::", "sig", "oh")
    ensure_checkpoint_dir(cases.sparkSession)
    # Signatures are costly and read by several branches: they are worked out once.
    keyed = narrow.where("sig is not null").select("case_id", "pos", "source", "exam_type", "confidence", cluster.alias("cluster")).checkpoint()
    contexts = keyed.groupBy("cluster").agg(F.max(F.col("exam_type") == "A").alias("has_a"), F.max(F.col("exam_type") == "B").alias("has_b"))
    split = F.when(F.col("has_a") & F.col("has_b") & (F.col("exam_type") == "B"), "B").otherwise("A")
    return (
        keyed.join(contexts, "cluster")
        .withColumn("merge_key", F.concat_ws("::", "cluster", split))
        .select("case_id", "pos", "source", "confidence", "merge_key")
    )


# Phrases of explanations that explain nothing.
PLACEHOLDERS = (
    "see reference for detailed explanation",
    "explanation unavailable",
    "no explanation available",
    "refer to textbook",
)


def is_placeholder(text: Column) -> Column:
    """Whether an explanation is missing, shorter than 20 characters, or one of the stock phrases."""
    low = F.lower(F.trim(text))
    stock = F.lit(False)
    for phrase in PLACEHOLDERS:
        stock = stock | low.contains(phrase)
    return F.coalesce((F.length(text) < 20) | stock, F.lit(True))


def golden_merge(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(golden records, redirects absorbed_id -> host_id).

    The host has the highest confidence (missing counts 0; ties by input
    order). The redirects are its aliases. DD04: it gains the first good
    rationale where its own is a placeholder; and, of the columns that are
    there, the first pearl of over 5 characters where its own has under 5, the
    first text of each distractor that it lacks (``distractors``: a map), and
    the union of ``tags``. DD05: where a further source agrees, the record is
    high-yield and gains 0.15 confidence for each (0.5 in all at most, 5.0 as
    the total; a missing or zero confidence counts 3.0 here); otherwise its
    confidence stays as it is, missing or not.
    """
    keys = merge_keys(cases)
    place = [(-F.coalesce("confidence", F.lit(0.0))).alias("back"), "pos"]
    has = {c: c in cases.columns for c in ("pearl", "distractors", "tags")}
    donors = keys.join(cases.select("case_id", "rationale", *[c for c, there in has.items() if there]), "case_id")
    first = lambda when, value: F.min(F.when(when, F.struct(*place, F.col(value).alias("text"))))["text"]
    grafts = [F.min(F.struct(*place, "case_id"))["case_id"].alias("host_id"), F.collect_set("source").alias("merged_sources"), F.count(F.lit(1)).alias("n_merged"), first(~is_placeholder(F.col("rationale")), "rationale").alias("graft")]
    if has["pearl"]:
        grafts.append(first(F.length("pearl") > 5, "pearl").alias("graft_pearl"))
    if has["tags"]:
        grafts.append(F.array_distinct(F.flatten(F.collect_set("tags"))).alias("graft_tags"))
    gathered = donors.groupBy("merge_key").agg(*grafts)
    if has["distractors"]:
        texts = donors.select("merge_key", *place, F.explode("distractors").alias("key", "text")).where("text <> ''")
        texts = texts.groupBy("merge_key", "key").agg(F.min(F.struct("back", "pos", "text"))["text"].alias("text"))
        gathered = gathered.join(texts.groupBy("merge_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "text")))).alias("graft_distractors")), "merge_key", "left")
    redirects = keys.join(gathered.select("merge_key", "host_id"), "merge_key").where("case_id <> host_id").select(F.col("case_id").alias("absorbed_id"), "host_id")
    hosts = cases.join(redirects, cases["case_id"] == redirects["absorbed_id"], "left_anti").join(gathered.withColumnRenamed("host_id", "case_id"), "case_id", "left")
    extra = F.coalesce(F.size("merged_sources") - 1, F.lit(0))
    bonus = F.least(extra * F.lit(0.15), F.lit(0.5))
    more = []
    if has["pearl"]:
        more.append(F.when(F.coalesce(F.length("pearl"), F.lit(0)) < 5, F.coalesce("graft_pearl", "pearl")).otherwise(F.col("pearl")).alias("pearl"))
    if has["distractors"]:
        none = F.create_map().cast("map<string,string>")
        own = F.map_filter(F.coalesce("distractors", none), lambda k, v: F.coalesce(v != "", F.lit(False)))
        lacking = F.map_filter(F.coalesce("graft_distractors", none), lambda k, v: ~F.map_contains_key(own, k))
        more.append(F.map_concat(own, lacking).alias("distractors"))
    if has["tags"]:
        more.append(F.array_sort(F.coalesce("graft_tags", "tags")).alias("tags"))
    golden = hosts.select(
        "case_id",
        "source",
        "exam_type",
        F.when(is_placeholder(F.col("rationale")), F.coalesce("graft", "rationale")).otherwise(F.col("rationale")).alias("rationale"),
        F.when(extra > 0, F.least(F.lit(5.0), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(3.0)) + bonus)).otherwise(F.col("confidence")).alias("confidence"),
        F.array_sort(F.coalesce("merged_sources", F.array("source"))).alias("merged_sources"),
        F.coalesce("n_merged", F.lit(1)).alias("n_merged"),
        (extra > 0).alias("is_high_yield"),
        *more,
    )
    return golden, redirects
