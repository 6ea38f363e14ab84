"""Wider audits, fixes and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable
from .audit import issues
from .rationale import is_placeholder


def audit_localization(df: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """QA04: rules (code, keyword, drug that is there, drug that is not) over stem and options."""
    text = F.lower(F.concat_ws(" ", F.col("question"), F.array_join(F.transform("options", lambda o: o["text"]), " ")))
    return issues(df, "D", [(code, "medium", text.rlike(k) & text.rlike(a) & ~text.rlike(b)) for code, k, a, b in rules])


def quality_audit(df: DataFrame) -> DataFrame:
    """QA05: eight categories of defect."""
    right = F.size(F.filter("options", lambda o: o["is_correct"]))
    texts = F.transform("options", lambda o: comparable(o["text"]))
    return issues(
        df,
        "Q",
        [
            ("no_options", "critical", F.size("options") == 0),
            ("no_correct", "critical", (F.size("options") > 0) & (right == 0)),
            ("multi_correct", "high", right > 1),
            ("truncated_question", "medium", F.trim("question").rlike("[,;:(-]$")),
            ("truncated_option", "low", F.exists("options", lambda o: F.trim(o["text"]).rlike("[,;(-]$"))),
            ("placeholder_rationale", "medium", is_placeholder(F.col("rationale"))),
            ("above_option", "low", F.exists("options", lambda o: F.lower(o["text"]).rlike("^(all|none) of the above"))),
            ("duplicate_options", "high", F.size(F.array_distinct(texts)) < F.size(texts)),
        ],
    )


def fix_keys(cases: DataFrame, named: DataFrame, findings_level: str = "high") -> DataFrame:
    """QA06/QA11: key by the letter a rationale names, where it is one letter, an option, and not the key: flip for a single statement, else hold."""
    own = cases.select("case_id", F.get(F.transform(F.filter("options", lambda o: o["is_correct"]), lambda o: o["id"]), F.lit(0)).alias("key"), F.transform("options", lambda o: o["id"]).alias("ids"))
    joined = named.join(own, "case_id").where(F.array_contains("ids", F.col("named")) & ~F.col("named").eqNullSafe(F.col("key")))
    return joined.select("case_id", "key", "named", F.when(F.col("several"), "hold").otherwise("flip").alias("action"))


def readability_queue(df: DataFrame, weights: dict[str, int]) -> DataFrame:
    """QA16: reasons for a rewrite with the sum of their weights as priority; cases without a reason are absent."""
    q = F.col("question")
    marks = {
        "html": q.rlike("<[a-z/][^>]*>"), "broken_lines": q.rlike("[a-z]\\n[a-z]"), "symbols": q.rlike("[#*%$&]{3,}"), "long_sentence": F.exists(F.split(q, "[.?!]"), lambda s: F.length(s) > 400),
        "no_space_after_stop": q.rlike("[a-z]\\.[A-Z]"), "shouting": q.rlike("([A-Z]{4,} ){4,}"),
    }
    reasons = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in marks.items()]), lambda x: x.isNotNull())
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]).cast("map<string,int>")
    return df.select("case_id", "source", reasons.alias("reasons")).where(F.size("reasons") > 0).withColumn("priority", F.aggregate("reasons", F.lit(0), lambda a, r: a + F.coalesce(weight[r], F.lit(1))))


def lane(queue: DataFrame) -> DataFrame:
    """SC11: lane of a queued case by its reasons; the first that fits."""
    has = lambda r: F.array_contains("reasons", r)
    out = F.when(has("html") | has("symbols"), "source_text").when(has("broken_lines") | has("no_space_after_stop"), "auto").when(has("shouting"), "editor").otherwise("advisory")
    return queue.withColumn("lane", out)


def queue_summary(queue: DataFrame, k: int = 25) -> DataFrame:
    """AG17: by reason, and by source the largest ``k``: dimension, value, n."""
    reasons = queue.select(F.explode("reasons").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("dimension", F.lit("reason"))
    sources = queue.groupBy(F.col("source").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k).withColumn("dimension", F.lit("source"))
    return reasons.unionByName(sources).select("dimension", "value", "n")


def audit_panel(df: DataFrame) -> DataFrame:
    """QA18/AG13: panel items (case_id, votes array<int>, hypothesis, narrative): structure and votes."""
    total = F.aggregate("votes", F.lit(0), lambda a, v: a + v)
    return issues(
        df,
        "P",
        [
            ("not_five_points", "critical", F.size("votes") != 5),
            ("no_votes", "critical", total == 0),
            ("small_panel", "medium", total.between(1, 9)),
            ("flat_votes", "low", (total > 0) & (F.array_max("votes") == F.array_min("votes"))),
            ("no_hypothesis", "high", F.trim(F.coalesce("hypothesis", F.lit(""))) == ""),
            ("short_vignette", "medium", F.length("narrative") < 50),
        ],
    )


def panel_metrics(df: DataFrame) -> DataFrame:
    """AG13: items, mean panel size and mean share of the modal vote."""
    total = F.aggregate("votes", F.lit(0), lambda a, v: a + v)
    rows = df.select(total.alias("t"), F.array_max("votes").alias("m")).where("t > 0")
    return rows.agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("t"), 4).alias("mean_panel"), F.round(F.avg(F.col("m") / F.col("t")), 4).alias("modal_agreement"))


def salvage_queue(df: DataFrame) -> DataFrame:
    """QA20: why a case's source text is worth another look: one row a reason."""
    q = F.lower("question")
    return issues(
        df,
        "V",
        [
            ("image_phrase", "medium", q.rlike("\\b(shown (below|above)|in the (image|figure|picture)|gambar)\\b")),
            ("ocr_token", "low", q.rlike("\\b[a-z]*[0-9][a-z]+[0-9][a-z]*\\b")),
            ("duplicate_option", "high", F.size(F.array_distinct(F.transform("options", lambda o: F.lower(F.trim(o["text"]))))) < F.size("options")),
            ("single_letters", "high", F.exists("options", lambda o: F.trim(o["text"]).rlike("^[A-Za-z]$"))),
            ("rough_rationale", "low", F.length(F.trim("rationale")).between(1, 30)),
        ],
    )


def distractor_conflicts(df: DataFrame) -> DataFrame:
    """AG15: maps of wrong-option texts (case_id, source, key, distractors) that hold the key, by source and in all (null source)."""
    marked = df.withColumn("bad", F.array_contains(F.map_keys("distractors"), F.col("key")).cast("int"))
    return marked.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("conflicts"))


def auto_fix(df: DataFrame) -> DataFrame:
    """EN14: titles from stems where they are missing, markdown marks removed, unknown exam types as BOTH."""
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.substring(F.trim("question"), 1, 60)).otherwise(F.col("title"))
    plain = F.regexp_replace("question", "(\\*\\*|__|`)", "")
    return df.withColumn("title", title).withColumn("question", plain).withColumn("exam_type", F.when(F.col("exam_type").isin("A", "B", "BOTH"), F.col("exam_type")).otherwise("BOTH"))


def apply_triage(manifest: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EN10: (manifest that stays, fixes): UNQUARANTINE and confident FIX release a case; KEEP and unsure ones do not."""
    freed = verdicts.where((F.col("verdict") == "UNQUARANTINE") | ((F.col("verdict") == "FIX") & (F.col("confidence") == "HIGH")))
    stays = manifest.join(freed.select("case_id"), "case_id", "left_anti")
    return stays, freed.where("verdict = 'FIX'").select("case_id", "new_key")


def apply_translation(options: DataFrame, translations: DataFrame) -> DataFrame:
    """EN11: option texts by (case_id, option_id) where a translation is there."""
    t = translations.select("case_id", "option_id", F.col("text").alias("_t"))
    return options.join(t, ["case_id", "option_id"], "left").withColumn("option_text", F.coalesce(F.nullif("_t", F.lit("")), "option_text")).drop("_t")


def apply_severity(cases: DataFrame, audit: DataFrame) -> DataFrame:
    """EN11: verdicts of a severity audit (case_id, pos, severity, reasoning, answer) on their cases; the last of a case stands.

    FATAL holds the case and keeps the suggested answer; MINOR and NONE are noted.
    """
    known = F.upper(F.coalesce("severity", F.lit("")))
    last = audit.groupBy("case_id").agg(F.max_by(F.struct(known.alias("verdict"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.nullif("answer", F.lit("")).alias("answer")), "pos").alias("_v"))
    fatal = F.coalesce(F.col("_v.verdict") == "FATAL", F.lit(False))
    joined = cases.join(last, "case_id", "left").withColumn("verdict", F.col("_v.verdict")).withColumn("reasoning", F.col("_v.reasoning"))
    return joined.withColumn("quarantined", F.col("quarantined") | fatal).withColumn("suggested_answer", F.when(fatal, F.col("_v.answer"))).drop("_v")


def panel_sizes(df: DataFrame) -> DataFrame:
    """AG13: per panel size (votes in all): items, those whose modal vote is a majority, and the mean length of their vignettes."""
    total = F.aggregate("votes", F.lit(0), lambda a, v: a + v)
    rows = df.select(total.alias("panel"), F.array_max("votes").alias("m"), F.length(F.coalesce("narrative", F.lit(""))).alias("length"))
    return rows.groupBy("panel").agg(F.count(F.lit(1)).alias("items"), F.count_if((F.col("panel") > 0) & (2 * F.col("m") > F.col("panel"))).alias("majority"), F.round(F.avg("length"), 4).alias("mean_vignette"))


def action_summary(queue: DataFrame, k: int = 15) -> DataFrame:
    """AG17: by suggested action (the lane of SC11) the ``k`` largest: action, n, sum of priorities, sources."""
    counted = lane(queue).groupBy(F.col("lane").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.sum("priority").alias("priority"), F.count_distinct("source").alias("sources"))
    return counted.orderBy(F.desc("n"), "action").limit(k)


def remediate(df: DataFrame, selector, patch, key: str = "case_id") -> DataFrame:
    """UD01: rows that ``selector`` picks go through ``patch`` (frame to frame) and replace themselves."""
    from ..sources.io import upsert

    return upsert(df, patch(df.where(selector)).select(*df.columns), key)


def issue_type(df: DataFrame, reported: DataFrame, priority: list[str]) -> DataFrame:
    """SC09: of the types reported for a case the first by priority; else by its state."""
    order = F.create_map(*[F.lit(x) for kv in ((p, i) for i, p in enumerate(priority)) for x in kv])
    best = reported.groupBy("case_id").agg(F.min_by("type", F.coalesce(order[F.col("type")], F.lit(len(priority)))).alias("_t"))
    live = F.when(F.size("options") < 2, "few_options").when(~F.exists("options", lambda o: o["is_correct"]), "no_key").when(F.col("truncated"), "truncated").otherwise("other")
    return df.join(best, "case_id", "left").select("case_id", F.coalesce("_t", live).alias("type"))


def tag_modes(df: DataFrame) -> DataFrame:
    """SC13: short-item mode and length bias of the key."""
    right = F.get(F.filter("options", lambda o: o["is_correct"]), F.lit(0))["text"]
    longest = F.array_max(F.transform(F.filter("options", lambda o: ~o["is_correct"]), lambda o: F.length(o["text"])))
    return df.select("case_id", (F.length("question") < 120).alias("rapid"), F.coalesce(F.length(right) > 1.5 * longest, F.lit(False)).alias("length_bias"))


def dataset_stats(df: DataFrame) -> DataFrame:
    """AG23: one row of shares of the bank."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("quarantined").alias("quarantined"), F.count_if(F.length("rationale") >= 100).alias("explained"), F.count_if(F.col("score") >= 80).alias("verified"),
        F.count_distinct("source").alias("sources"), F.count_distinct("category").alias("categories"),
    )


def smoke(df: DataFrame) -> DataFrame:
    """QA21: checks of all layers as name, passed, n: structure, keys, rationale share, ids."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("options") < 2).alias("few_options"), F.count_if(~F.exists("options", lambda o: o["is_correct"])).alias("no_key"),
        F.count_if(F.length("rationale") == 0).alias("no_rationale"), (F.count(F.lit(1)) - F.count_distinct("case_id")).alias("repeated_ids"),
    )
    checks = F.array(
        *[F.struct(F.lit(n).alias("name"), ok.alias("passed"), F.col(n).alias("n")) for n, ok in (("few_options", F.col("few_options") * 20 <= F.col("rows")), ("no_key", F.col("no_key") * 20 <= F.col("rows")), ("no_rationale", F.col("no_rationale") * 20 <= F.col("rows")), ("repeated_ids", F.col("repeated_ids") == 0))]
    )
    return row.select(F.explode(checks).alias("c")).select("c.*")


def deep_audit(df: DataFrame) -> DataFrame:
    """QA17: damage of explanations and fields: leads, references, page and image marks, markup, empty parts."""
    r, low = F.col("rationale"), F.lower("rationale")
    return issues(
        df,
        "X",
        [
            ("answer_lead", "low", low.rlike("^\\s*(ans|answer|jawaban)\\s*[:.-]")),
            ("reference", "low", low.rlike("ref(erence)?s?\\s*[:.-]")),
            ("page_mark", "low", low.rlike("pg\\.?\\s*(no\\.?)?\\s*[0-9]+")),
            ("image_mark", "low", low.rlike("\\[(image|figure|img)")),
            ("markup", "medium", r.rlike("</?[a-z]+[^>]*>")),
            ("odd_symbols", "low", r.rlike("[#*%$&]{3,}")),
            ("mojibake", "medium", r.rlike("[ÂÃ][^ ]")),
            ("no_title", "low", F.trim("title") == ""),
            ("no_narrative", "low", F.trim("narrative") == ""),
            ("no_confidence", "low", F.col("confidence").isNull()),
        ],
    )


def category_pack(resolved: DataFrame, buckets: dict[str, str]) -> DataFrame:
    """SC12: shortlist rows (case_id, bucket, allowed): resolved cases that a bucket's predicate (SQL over the frame) picks, with the categories it may take."""
    names = F.filter(F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in buckets.items()]), lambda x: x.isNotNull())
    allowed = F.array_distinct(F.filter(F.array("raw", "resolved", "runner_up"), lambda x: x.isNotNull()))
    return resolved.select("case_id", F.explode(names).alias("bucket"), allowed.alias("allowed"))
