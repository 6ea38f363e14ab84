"""Category resolution by weighted signals, and rule tables for tags and lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matcher import Dictionary, matches
from .ids import dense_numbers

# Weights of the signals, and thresholds of score and lead.
WEIGHTS = {"raw": 4, "subject": 3, "tags": 3, "topic": 3, "organ": 3, "prefix": 2, "keyword": 1, "narrative": 2, "options": 1}
HIGH, MEDIUM, LEAD = 5, 3, 2
UNCLASSIFIED = "Unclassified"
CONTENT = ("tags", "topic", "organ", "keyword", "narrative", "options")


def match_keywords(df: DataFrame, fields: dict[str, str], words: dict[str, list[str]], beginnings: set[str] = frozenset()) -> DataFrame:
    """UD02: case_id, signal, category, word for dictionary words that stand as whole words in the fields.

    Words in ``beginnings`` match longer words too. All are found in one pass.
    """
    return matches(df, fields, Dictionary.of(words, beginnings))


def resolve_category(cases: DataFrame, signals: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """SC01: the category of most weight, its runner-up, confidence and conflict.

    A signal counts once for each category; two content signals that agree add
    2. The raw category of the case is a signal of its own. Ties go by name.
    """
    w = WEIGHTS | (weights or {})
    weight = F.create_map(*[F.lit(x) for kv in w.items() for x in kv])
    raw = cases.where("category is not null").select("case_id", F.lit("raw").alias("signal"), "category")
    rows = signals.select("case_id", "signal", "category").unionByName(raw).distinct()
    scored = rows.groupBy("case_id", "category").agg(
        (F.sum(F.coalesce(weight[F.col("signal")], F.lit(0))) + F.when(F.count_if(F.col("signal").isin(*CONTENT)) >= 2, 2).otherwise(0)).alias("score")
    )
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), "category")
    two = scored.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    best = two.groupBy("case_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("category"))).alias("resolved"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rn") == 2, F.col("category"))).alias("runner_up"), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))), F.lit(0)).alias("runner_score"),
    )
    lead = F.col("score") - F.col("runner_score") >= LEAD
    confidence = F.when((F.col("score") >= HIGH) & lead, "high").when((F.col("score") >= MEDIUM) & lead, "medium").otherwise("low")
    joined = cases.select("case_id", F.col("category").alias("raw")).join(best, "case_id", "left")
    return joined.select(
        "case_id", F.coalesce("resolved", F.lit(UNCLASSIFIED)).alias("resolved"), F.coalesce("score", F.lit(0)).alias("score"), "runner_up", F.coalesce("runner_score", F.lit(0)).alias("runner_score"),
        F.coalesce(confidence, F.lit("low")).alias("confidence"), (F.coalesce(F.col("raw") != F.col("resolved"), F.lit(False)) | F.coalesce(F.col("runner_score") >= 3, F.lit(False))).alias("conflict"),
    )


def apply_category(resolved: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """SC04: an adjudicated category stands; else the resolved one where confidence is high; else the raw one, for review."""
    joined = resolved.join(adjudicated.select("case_id", F.col("category").alias("_a")), "case_id", "left")
    final = F.when(F.col("_a").isNotNull(), F.col("_a")).when(F.col("confidence") == "high", F.col("resolved")).otherwise(F.coalesce("raw", F.lit(UNCLASSIFIED)))
    return joined.withColumn("final", final).withColumn("review", F.col("_a").isNull() & (F.col("confidence") != "high") & F.col("conflict")).drop("_a")


def category_audit(resolved: DataFrame, k: int = 25) -> DataFrame:
    """AG07: the most frequent pairs of raw and resolved category that differ."""
    return resolved.where("raw <> resolved").groupBy("raw", "resolved").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "raw", "resolved").limit(k)


def category_counts(applied: DataFrame) -> DataFrame:
    """AG07: dimension, value, n: cases by raw, resolved and final category and by confidence, and as outcomes those that were
    fixed without a reviewer, wait for one, or have no category; from one pass over ``applied`` (SC04)."""
    names = ["raw", "resolved", "final", "confidence"]
    fixed = F.coalesce(F.col("final") != F.col("raw"), F.col("final") != UNCLASSIFIED) & ~F.col("review")
    outcome = F.array(F.when(fixed, "auto_fixed"), F.when(F.col("review"), "queued"), F.when(F.col("final") == UNCLASSIFIED, "unclassified"))
    kinds = [F.struct(F.lit(n).alias("dimension"), F.coalesce(n, F.lit(UNCLASSIFIED)).alias("value")) for n in names]
    more = F.transform(F.filter(outcome, lambda x: x.isNotNull()), lambda x: F.struct(F.lit("outcome").alias("dimension"), x.alias("value")))
    return applied.select(F.explode(F.concat(F.array(*kinds), more)).alias("k")).groupBy("k.dimension", "k.value").agg(F.count(F.lit(1)).alias("n"))


def map_sources(cases: DataFrame, table: DataFrame, allowed: list[str]) -> DataFrame:
    """SC05: category by source, where the table's category is allowed."""
    good = table.where(F.col("category").isin(*allowed)).select("source", F.col("category").alias("_c"))
    return cases.join(good, "source", "left").withColumn("category", F.coalesce("_c", "category")).drop("_c")


def tag_topics(matches: DataFrame, cases: DataFrame, most: int = 8) -> DataFrame:
    """SC06: the category with most distinct words (ties by name) and at most eight of them; general without any."""
    per = matches.groupBy("case_id", "category").agg(F.count_distinct("word").alias("n"), F.array_sort(F.collect_set("word")).alias("words"))
    best = per.groupBy("case_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "category", "words")).alias("b"))
    return cases.select("case_id").join(best, "case_id", "left").select("case_id", F.coalesce("b.category", F.lit("general")).alias("organ"), F.coalesce(F.array_join(F.slice("b.words", 1, most), ","), F.lit("")).alias("words"))


def regex_tags(c: Column, rules: dict[str, str]) -> Column:
    """SC07: names of the rules whose pattern is in the text, in order."""
    return F.filter(F.array(*[F.when(F.lower(c).rlike(p), F.lit(n)) for n, p in rules.items()]), lambda x: x.isNotNull())


def first_rule(c: Column, rules: dict[str, str], fallback: str) -> Column:
    """SC07: the first rule that matches."""
    out = F.lit(fallback)
    for name, pattern in reversed(list(rules.items())):
        out = F.when(F.lower(c).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def fill_gaps(candidates: DataFrame, needed: DataFrame) -> DataFrame:
    """SC08: of candidates (case_id, category) as many as a category needs, by id; numbered over ranges, so no category is one task."""
    numbered = dense_numbers(candidates, ["case_id"], "_n", ["category"])
    return numbered.join(needed, "category").where(F.col("_n") <= F.col("needed")).select("case_id", "category")


def changed_only(before: DataFrame, after: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """SC14: rows of ``after`` whose values differ from ``before``; new rows are changes."""
    digest = lambda: F.xxhash64(*cols)
    old = before.select(key, digest().alias("_h"))
    return after.join(old, key, "left").where(F.col("_h").isNull() | (digest() != F.col("_h"))).drop("_h")
