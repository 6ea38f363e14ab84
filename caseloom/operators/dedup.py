"""Duplicate and conflict groups of cases.

All group work is done by aggregates on narrow columns first; whole records are
joined back only for the rows that a group needs. ``pos`` (input order) breaks
every tie, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signature import semantic_sig
from ..functions.text import alnum, comparable, fingerprint


def cross_source_dedup(cases: DataFrame, answers: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """DD07/DD08: the same stem in several sources: duplicates where all answers agree, conflicts otherwise.

    ``answers`` has (case_id, answer), one row for each correct option. A case
    without exactly one answer makes its group a conflict. Returned are the
    rows of groups with at least two rows and two sources: case_id, fp, n, n_sources, state, canonical_id.
    """
    one = answers.groupBy("case_id").agg(F.when(F.count(F.lit(1)) == 1, F.min(comparable("answer"))).alias("answer"))
    rank = F.lit(0)
    if priority:
        rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col("source")], F.lit(0))
    narrow = (
        cases.select("case_id", "pos", "source", "score", F.length("rationale").alias("rl"), F.length("question").alias("ql"), fingerprint("question").alias("fp"))
        .where(F.col("ql") > 0)
        .withColumn("rank", rank)
    )
    groups = (
        narrow.join(one, "case_id", "left")
        .groupBy("fp")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("source").alias("n_sources"),
            F.count("answer").alias("answered"),
            F.min("answer").alias("lo"),
            F.max("answer").alias("hi"),
            F.max(F.struct("rank", "score", "rl", "ql", (-F.col("case_id")).alias("back"))).alias("best"),
        )
        .where("n >= 2 and n_sources >= 2")
        .select("fp", "n", "n_sources", F.when((F.col("answered") == F.col("n")) & (F.col("lo") == F.col("hi")), "duplicate").otherwise("conflict").alias("kind"), (-F.col("best.back")).alias("canonical_id"))
    )
    state = F.when(F.col("kind") == "conflict", "conflict").when(F.col("case_id") == F.col("canonical_id"), "canonical").otherwise("duplicate")
    return narrow.select("case_id", "fp").join(groups, "fp").select("case_id", "fp", "n", "n_sources", state.alias("state"), "canonical_id")


def prefix_duplicates(cases: DataFrame, chars: int = 80, least: int = 25) -> DataFrame:
    """DD09: comparable beginnings that several cases of several sources share."""
    key = F.substring(comparable("question"), 1, chars)
    return (
        cases.select("case_id", "source", key.alias("prefix"))
        .where(F.length("prefix") >= least)
        .groupBy("prefix")
        .agg(F.count_distinct("case_id").alias("n_cases"), F.count_distinct("source").alias("n_sources"), F.min("case_id").alias("first_id"))
        .where("n_cases >= 2 and n_sources >= 2")
    )


def first_of_key(cases: DataFrame, key, least: int) -> DataFrame:
    """DD11/DD13/WN04: case_id, first_id (smallest pos of the same key) for keys of at least ``least`` characters."""
    keyed = cases.select("case_id", "pos", key.alias("key")).where(F.length("key") >= least)
    firsts = keyed.groupBy("key").agg(F.min_by("case_id", "pos").alias("first_id"))
    return keyed.join(firsts, "key").select("case_id", "first_id")


def drop_prefix_dups(cases: DataFrame, chars: int = 100, least: int = 20) -> DataFrame:
    """DD11: cases without those whose beginning an earlier case has; short ones stay."""
    later = first_of_key(cases, F.substring(alnum("question"), 1, chars), least).where("case_id <> first_id")
    return cases.join(later.select("case_id"), "case_id", "left_anti")


def near_dups(cases: DataFrame, chars: int = 80, least: int = 30) -> DataFrame:
    """DD12: groups of at least two cases with one lower-cased beginning."""
    return (
        cases.where(F.length("question") >= least)
        .groupBy(F.substring(F.lower("question"), 1, chars).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first_id"), F.max("case_id").alias("last_id"))
        .where("n >= 2")
    )


def duplicate_narratives(cases: DataFrame, chars: int = 150, least: int = 51) -> DataFrame:
    """DD13: later cases with the narrative of an earlier one, letters and digits alone."""
    return first_of_key(cases, F.substring(alnum("narrative"), 1, chars), least).where("case_id <> first_id")


def signature_groups(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """DD14: cases with one semantic signature; a conflict has several answers (first three words) and several sources."""
    short = answers.select("case_id", F.array_join(F.slice(F.split(comparable("answer"), " "), 1, 3), " ").alias("answer"))
    short = short.groupBy("case_id").agg(F.min("answer").alias("answer"))
    return (
        cases.select("case_id", "source", semantic_sig(F.col("question")).alias("sig"))
        .where("sig is not null")
        .join(short, "case_id", "left")
        .groupBy("sig")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.count_distinct(F.nullif("answer", F.lit(""))).alias("n_answers"), F.min("case_id").alias("first_id"))
        .where("n >= 2")
        .withColumn("kind", F.when((F.col("n_answers") > 1) & (F.col("n_sources") > 1), "conflict").otherwise("duplicate"))
    )


def keep_best(cases: DataFrame, members: DataFrame) -> DataFrame:
    """DD10: of each group (group_id, case_id), the case of best quality; the others with their reason.

    Order: not quarantined, longer rationale tier, confidence, narrative length, smaller id.
    """
    tier = F.when(F.length("rationale") >= 150, 2).when(F.length("rationale") >= 50, 1).otherwise(0)
    ranked = members.join(
        cases.select("case_id", (~F.col("quarantined")).alias("free"), tier.alias("tier"), F.coalesce("confidence", F.lit(0.0)).alias("c"), F.length("narrative").alias("n")), "case_id"
    )
    best = ranked.groupBy("group_id").agg(F.max(F.struct("free", "tier", "c", "n", (-F.col("case_id")).alias("b"))).alias("best"))
    return ranked.join(best, "group_id").select("group_id", "case_id", (-F.col("best.b")).alias("best_id"), (F.col("case_id") == -F.col("best.b")).alias("kept"))


def fix_ids(cases: DataFrame) -> DataFrame:
    """DD19: the first holder of an id keeps it; later ones are numbered above the largest id, in input order.

    Numbers come from sizes of ranges of ``pos`` (PR11), so no single task sorts all rows.
    """
    from .ids import dense_numbers

    first = Window.partitionBy("case_id").orderBy("pos")
    marked = cases.withColumn("_rn", F.row_number().over(first))
    keep = marked.where("_rn = 1").withColumn("new_id", F.col("case_id")).drop("_rn")
    top = cases.agg(F.coalesce(F.max("case_id"), F.lit(0)).alias("top"))
    late = dense_numbers(marked.where("_rn > 1").drop("_rn"), ["pos"], "_n").crossJoin(F.broadcast(top))  # one row
    return keep.unionByName(late.withColumn("new_id", F.col("top") + F.col("_n")).drop("top", "_n"))


def dedupe_options(cases: DataFrame) -> DataFrame:
    """DD20: equal options of a case become one, the correct one where there is one, else the first.

    A case that would have fewer than two options stays as it is; two different
    correct options ask for a review.
    """
    keyed = F.transform("options", lambda o, i: F.struct(comparable(o["text"]).alias("k"), (~o["is_correct"]).alias("wrong"), i.alias("i"), o.alias("o")))
    firsts = F.filter(keyed, lambda x: ~F.exists(keyed, lambda y: (y["k"] == x["k"]) & ((y["wrong"] < x["wrong"]) | ((y["wrong"] == x["wrong"]) & (y["i"] < x["i"])))))
    kept = F.transform(firsts, lambda x: x["o"])
    out = F.when(F.size(kept) >= 2, kept).otherwise(F.col("options"))
    return cases.withColumn("options", out).withColumn("review_options", F.size(F.filter("options", lambda o: o["is_correct"])) > 1)
