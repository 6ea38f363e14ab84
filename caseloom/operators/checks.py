"""Checks of a whole bank: smoke in layers (QA21), publish rules (QA22), cues that give answers away (AG12), quarantine reasons (FL05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import corruption_reason
from .healing import stated_option

# Words of the published cues.
NEGATIVE = r"(?i)\b(kecuali|tidak|bukan|salah|kurang tepat|tidak benar)\b"
ALL_ABOVE = r"(?i)\b(semua\s+(pilihan|jawaban|di\s*atas)\s*(benar|salah|tepat))\b"
NONE_ABOVE = r"(?i)\b(tidak\s+ada\s+(pilihan|jawaban|di\s*atas)|bukan\s+salah\s+satu)\b"
ABSOLUTE = r"(?i)\b(selalu|tidak pernah|hanya|pasti|mutlak|semua)\b"
CIRCULAR = r"(?i)\b(adalah\s+jawaban\s+yang\s+(benar|tepat)|sudah\s+jelas|pilihan\s+terbaik)\b"
LONGEST_OPTION, LEAST_PROMPT, LEAST_EXPLAINED = 1500, 10, 0.95


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _rows(counted: DataFrame, names: list[str]) -> DataFrame:
    """A row for each of the columns ``names`` of a one-row frame: name, n."""
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("n")) for n in names])).alias("c")).select("c.*")


def option_print(options: Column, chars: int = 30) -> Column:
    """The options' beginnings in lower case, sorted: what a raw record of the same question has too."""
    return F.array_join(F.array_sort(F.transform(options, lambda o: F.substring(F.lower(F.trim(F.coalesce(o["text"], F.lit("")))), 1, chars))), "|")


def _words(c: Column, least: int) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?<![A-Za-z0-9_])[a-z]+(?![A-Za-z0-9_])"), F.lit(0)), lambda w: F.length(w) >= least)


def smoke_layers(df: DataFrame, raw: DataFrame, source: str) -> DataFrame:
    """QA21: layer, name, n, passed for the seven layers; ``raw`` (fp, key) are records of ``source``.

    1 structure, 2 keys against the raw source, 3 explanations against keys (of
    all cases, not of a sample), 4 keys and explanations by source, 5 the first
    case of each of the five largest sources, 6 what was repaired
    (``antidote``, ``needs_regen``, ``regenerated``), 7 odd texts and options.
    """
    n = F.coalesce(F.size("options"), F.lit(0))
    right = F.filter("options", lambda o: o["is_correct"])
    said = F.lower(_text("rationale"))
    key_words = _words(_text_of(right), 4)
    hits = lambda words: F.size(F.filter(words, lambda w: F.col("_r").contains(w)))
    rows = df.withColumns({"_r": said, "_n": n, "_right": right, "_kw": key_words, "_q": F.coalesce(F.nullif("narrative", F.lit("")), F.nullif("prompt", F.lit("")), F.lit(""))})
    wrong_more = F.exists(F.filter("options", lambda o: ~o["is_correct"]), lambda o: (F.size(_words(o["text"], 5)) >= 2) & (hits(_words(o["text"], 5)) > hits(F.col("_kw")) + 2))
    explained = (F.col("q_type") == "MCQ") & (F.size("_right") > 0) & (F.length("_r") >= 30)
    coherent = ((F.size("_kw") == 0) | (hits(F.col("_kw")) > 0)) & ~wrong_more
    texts = F.transform("options", lambda o: F.lower(F.trim(F.coalesce(o["text"], F.lit("")))))
    fits = F.col("_n") >= 2
    layers: dict[int, dict[str, Column]] = {
        1: {
            "no_question": F.col("_q") == "", "no_options": ~fits, "no_correct": fits & (F.size("_right") == 0), "multi_correct": fits & (F.size("_right") > 1), "empty_option_text": fits & F.exists(texts, lambda t: t == ""),
        },
        3: {"coherent": explained & coherent, "suspicious": explained & ~coherent, "no_rationale": (F.col("q_type") == "MCQ") & ~explained},
        6: {"antidoted_with_rationale": F.col("antidote") & (F.length("_r") > 30), "antidoted_without": F.col("antidote") & (F.length("_r") <= 30), "needs_regen": F.col("needs_regen"), "regenerated": F.col("regenerated")},
        7: {
            "very_short_question": (F.col("q_type") == "MCQ") & (F.length("_q") < 20), "truncated_vignette": F.col("_q").endswith("..."), "html_in_text": F.col("_q").rlike("(?i)<[a-z]+>"),
            "duplicate_options": F.size(F.array_distinct(texts)) < F.col("_n"), "all_same_options": fits & (F.size(F.array_distinct(texts)) == 1),
        },
    }
    counted = rows.agg(*[F.count_if(p).alias(f"{layer}:{name}") for layer, checks in layers.items() for name, p in checks.items()])
    one = _rows(counted, [f"{layer}:{name}" for layer, checks in layers.items() for name in checks])
    out = one.select(F.split("name", ":")[0].cast("int").alias("layer"), F.split("name", ":")[1].alias("name"), "n")
    ids = df.groupBy("case_id").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
    keys = raw.where("key is not null").groupBy("fp").agg(F.min_by("key", "pos").alias("_key"))
    met = rows.where(F.col("source") == source).select(option_print(F.col("options")).alias("fp"), F.get(F.col("_right"), F.lit(0))["id"].alias("own")).join(keys, "fp", "left")
    crossed = met.agg(F.count_if(F.col("_key").eqNullSafe(F.col("own")) & F.col("_key").isNotNull()).alias("matched"), F.count_if(F.col("_key").isNotNull() & ~F.col("_key").eqNullSafe(F.col("own"))).alias("mismatch"), F.count_if(F.col("_key").isNull()).alias("not_found"))
    by_source = rows.groupBy(F.coalesce("source", F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("_r") > 20).alias("r"), F.count_if(F.size("_right") > 0).alias("k"), F.min_by(F.struct((F.size("_right") > 0).alias("has"), (F.length("_r") > 30).alias("says")), "case_id").alias("first"))
    largest = by_source.orderBy(F.desc("n"), "name").limit(5)
    good = {"coherent", "matched", "regenerated", "antidoted_with_rationale", "multi_correct", "no_rationale", "not_found", "needs_regen"}
    counts = out.unionByName(ids.select(F.lit(1).alias("layer"), F.lit("duplicate_ids").alias("name"), "n")).unionByName(_rows(crossed, ["matched", "mismatch", "not_found"]).select(F.lit(2).alias("layer"), "name", "n"))
    counts = counts.withColumn("passed", F.col("name").isin(*good) | (F.col("n") == 0))
    fourth = by_source.select(F.lit(4).alias("layer"), "name", "n", ((F.col("k") == F.col("n")) & (2 * F.col("r") >= F.col("n"))).alias("passed"))
    return counts.unionByName(fourth).unionByName(largest.select(F.lit(5).alias("layer"), "name", F.lit(1).cast("long").alias("n"), (F.col("first.has") & F.col("first.says")).alias("passed")))


def _text_of(right: Column) -> Column:
    return F.coalesce(F.get(right, F.lit(0))["text"], F.lit(""))


def publish_checks(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """QA22: name, n, passed of every rule for publishing; ``manifest`` (id as text) names what is held back.

    Repeated ids and codes are counted on these columns alone.
    """
    right = F.size(F.filter("options", lambda o: o["is_correct"]))
    prompt = F.coalesce(F.nullif("prompt", F.lit("")), F.nullif("question", F.lit("")), F.nullif("narrative", F.lit("")), F.lit(""))
    counted = df.agg(
        F.count_if(F.col("case_id").isNull()).alias("missing_id"),
        F.count_if(_text("case_code") == "").alias("missing_case_code"),
        F.count_if(F.length(F.trim(prompt)) < LEAST_PROMPT).alias("prompt_too_short"),
        F.count_if(~F.coalesce(F.size("options"), F.lit(0)).between(2, 5)).alias("bad_option_count"),
        F.count_if(right != 1).alias("bad_correct_count"),
        F.sum(F.size(F.filter("options", lambda o: F.trim(F.coalesce(o["text"], F.lit(""))) == ""))).alias("empty_option_text"),
        F.sum(F.size(F.filter("options", lambda o: F.length(o["text"]) > LONGEST_OPTION))).alias("option_too_long"),
        F.when(F.avg((_text("rationale") != "").cast("int")) < LEAST_EXPLAINED, F.count_if(_text("rationale") == "")).otherwise(0).alias("unexplained_beyond_five_percent"),
    )
    rows = _rows(counted, counted.columns)
    repeated = lambda c, name: df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    number = F.expr("try_cast(id as long)")
    entries = manifest.select("id", number.alias("number"))
    ids = df.select(F.col("case_id").alias("number")).distinct()
    held = entries.where("number is not null")
    text_of = lambda i: F.get(F.filter("options", lambda o: o["id"] == i), F.lit(0))["text"]
    free = df.where(F.size("options") >= 2).join(held.select(F.col("number").alias("case_id")).distinct(), "case_id", "left_anti")
    against = free.withColumn("_to", stated_option(F.col("rationale"), F.col("options"))).withColumn("_key", F.get(F.filter("options", lambda o: o["is_correct"]), F.lit(0)))
    one = lambda frame, name: frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    from ..functions.text import comparable

    for more in (
        repeated("case_id", "duplicate_ids"), repeated("case_code", "duplicate_case_codes"), one(entries.where("number is null"), "manifest_non_numeric"),
        one(held.select("number").distinct().join(ids, "number", "left_anti"), "manifest_unknown"), held.groupBy("number").agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).select(F.lit("manifest_duplicate").alias("name"), "n"),
        one(against.where(F.col("_to").isNotNull() & F.col("_key").isNotNull() & (comparable(text_of(F.col("_to"))) != comparable(F.col("_key.text")))), "hard_contradictions"),
    ):
        rows = rows.unionByName(more)
    return rows.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("passed", F.col("n") == 0)


def psychometrics(df: DataFrame) -> DataFrame:
    """AG12: one row of what gives answers away, over cases with a key and other options: lengths, negative prompts, lazy and absolute
    options, the key's place, words shared with the stem, explanations that only repeat that it is right."""
    right, wrong = F.filter("options", lambda o: o["is_correct"]), F.filter("options", lambda o: ~o["is_correct"])
    length = lambda o: F.length(F.coalesce(o["text"], F.lit("")))
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", " "), r"\s+"), lambda w: F.length(w) > 3))
    rows = df.where((F.size(right) > 0) & (F.size(wrong) > 0)).select(
        length(right[0]).alias("c"), (F.aggregate(wrong, F.lit(0), lambda a, o: a + length(o)) / F.size(wrong)).alias("w"), _text("prompt").rlike(NEGATIVE).alias("negative"),
        F.size(F.filter("options", lambda o: o["text"].rlike(ALL_ABOVE))).alias("all_above"), F.size(F.filter("options", lambda o: o["text"].rlike(NONE_ABOVE))).alias("none_above"),
        F.size(F.filter(right, lambda o: o["text"].rlike(ABSOLUTE))).alias("abs_right"), F.size(F.filter(wrong, lambda o: o["text"].rlike(ABSOLUTE))).alias("abs_wrong"),
        (F.array_position(F.transform("options", lambda o: o["is_correct"]), True) - 1).alias("at"), words(F.concat_ws(" ", _text("narrative"), _text("prompt"))).alias("stem"), words(right[0]["text"]).alias("rw"),
        F.transform(wrong, lambda o: words(o["text"])).alias("ww"), (_text("rationale").rlike(CIRCULAR) & (F.length(_text("rationale")) < 150)).alias("circular"),
    )
    shared = F.size(F.array_intersect("stem", "rw"))
    best = F.array_max(F.transform("ww", lambda ws: F.size(F.array_intersect(F.col("stem"), ws))))
    return rows.agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("c"), 4).alias("mean_right"), F.round(F.avg("w"), 4).alias("mean_wrong"), F.count_if(F.col("c") > 1.5 * F.col("w")).alias("longer_right"), F.count_if(F.col("c") < 0.6 * F.col("w")).alias("shorter_right"),
        F.count_if("negative").alias("negative_prompts"), F.sum("all_above").alias("all_of_the_above"), F.sum("none_above").alias("none_of_the_above"), F.count_if(F.col("abs_right") + F.col("abs_wrong") > 0).alias("absolute_terms"),
        F.sum("abs_right").alias("absolute_right"), F.sum("abs_wrong").alias("absolute_wrong"), *[F.count_if(F.col("at") == k).alias(f"key_at_{k}") for k in range(5)], F.count_if(F.col("at") > 4).alias("key_at_other"),
        F.count_if((shared > best) & (shared > 0)).alias("word_match_cue"), F.count_if("circular").alias("circular_rationale"),
    )


def quarantine_reason(df: DataFrame) -> DataFrame:
    """FL05: case_id and the first reason to hold a case: its text is damaged, or it has no correct answer (of two options at least)."""
    text = F.coalesce(F.nullif("question", F.lit("")), F.nullif("narrative", F.lit("")), F.col("title"), F.lit(""))
    keyless = (F.coalesce(F.size("options"), F.lit(0)) < 2) | ~F.exists("options", lambda o: o["is_correct"])
    return df.select("case_id", F.coalesce(corruption_reason(text), F.when(keyless, "no_correct_answer")).alias("reason")).where("reason is not null")
