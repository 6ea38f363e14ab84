"""What explanations say about the options: cutting, mining and checking them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable


def split_wall(c: Column, least: int = 10) -> Column:
    """EN01: explanations of single options cut out of a long text: map of letter to text; the first pattern that hits, the first text of a letter."""
    # Lead-ins of an option's part.
    patterns = ("(?s)\\(([A-E])\\)\\s*(.*?)(?=\\([A-E]\\)|\\z)", "(?s)\\bOption ([A-E])\\s*[:.-]\\s*(.*?)(?=\\bOption [A-E]\\s*[:.-]|\\z)", "(?s)(?:^|\\n)([A-E])[.)]\\s*(.*?)(?=\\n[A-E][.)]|\\z)")
    out = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    for p in reversed(patterns):
        letters, texts = F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.regexp_extract_all(c, F.lit(p), F.lit(2))
        pairs = F.filter(F.zip_with(letters, texts, lambda k, t: F.struct(k.alias("k"), F.trim(t).alias("t"))), lambda x: F.length(x["t"]) >= least)
        keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
        firsts = F.transform(keys, lambda k: F.filter(pairs, lambda x: x["k"] == k)[0]["t"])
        out = F.when(F.size(pairs) > 0, F.map_from_arrays(keys, firsts)).otherwise(out)
    return out


def inject_pearl(text: Column, pearl: Column, rules: dict[str, str]) -> Column:
    """EN02: a pearl for the first keyword in the text where the present one is under ten characters."""
    out = pearl
    for pattern, found in reversed(list(rules.items())):
        out = F.when(F.lower(text).rlike(pattern), F.lit(found)).otherwise(out)
    return F.when(F.length(F.coalesce(pearl, F.lit(""))) >= 10, pearl).otherwise(out)


PLACEHOLDER = "^(\\s*|n/?a|none|no explanation( available)?\\.?|explanation unavailable\\.?|tbd)$"


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).rlike(PLACEHOLDER)


def enrich_queue(df: DataFrame) -> DataFrame:
    """EN03: keyed cases whose rationale is empty or a placeholder, with the request body (FN26)."""
    keyed = F.exists("options", lambda o: o["is_correct"])
    body = F.to_json(F.struct("case_id", F.substring("question", 1, 2000).alias("question"), F.transform("options", lambda o: F.struct(o["id"].alias("id"), o["text"].alias("text"))).alias("options")))
    return df.where(keyed & is_placeholder(F.col("rationale"))).select("case_id", body.alias("body"))


def purge_placeholders(df: DataFrame) -> DataFrame:
    """EN05: placeholder rationales become empty and cost ten points of score."""
    gone = is_placeholder(F.col("rationale")) & (F.length("rationale") > 0)
    return df.withColumn("score", F.when(gone, F.greatest(F.col("score") - 10, F.lit(0.0))).otherwise(F.col("score"))).withColumn("rationale", F.when(gone, F.lit("")).otherwise(F.col("rationale")))


def rationale_answers(df: DataFrame) -> DataFrame:
    """QA08/UD04: the option a rationale names, with its offset: the last statement of an answer letter wins.

    Ordered matches with offsets, in Arrow batches over (case_id, rationale).
    """
    cue = re.compile(r"(?i)\b(?:correct answer|answer|jawaban|best option|correct option)\b[^A-Za-z0-9]{0,4}(?:is|adalah)?[^A-Za-z0-9]{0,3}\(?([A-E])\b\)?")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for case, said in zip(pdf["case_id"], pdf["rationale"]):
                found = [(m.start(1), m[1].upper()) for m in cue.finditer(said or "")]
                if found:
                    rows.append((case, found[-1][1], found[-1][0], len({x for _, x in found}) > 1))
            yield pd.DataFrame(rows, columns=["case_id", "named", "at", "several"])

    return df.select("case_id", "rationale").mapInPandas(run, "case_id long, named string, at long, several boolean")


def except_trap(df: DataFrame) -> DataFrame:
    """QA09: negative stems whose rationale affirms the key close to its text."""
    key = F.lower(F.get(F.filter("options", lambda o: o["is_correct"]), F.lit(0))["text"])
    at = F.instr(F.lower("rationale"), key)
    window = F.substring(F.lower("rationale"), F.greatest(at - 40, F.lit(1)), F.length(key) + 80)
    negative = F.lower("question").rlike("\\b(except|not|incorrect|false|least likely)\\b")
    return df.where(negative & (F.length(key) > 3) & (at > 0) & window.rlike("\\b(is true|is correct|is seen|is associated|are seen)\\b")).select("case_id")


def dissonance(cases: DataFrame, answers: DataFrame, variants: DataFrame, least: int = 5) -> DataFrame:
    """QA13: cases with no strong token of the answer, nor a variant of one (token, variant), in the rationale."""
    tokens = answers.select("case_id", F.explode(F.array_distinct(F.filter(F.split(comparable("answer"), " "), lambda w: F.length(w) >= least))).alias("token"))
    forms = tokens.join(variants.groupBy("token").agg(F.collect_set("variant").alias("vs")), "token", "left").withColumn("vs", F.array_union(F.array("token"), F.coalesce("vs", F.array().cast("array<string>"))))
    text = cases.select("case_id", comparable("rationale").alias("r")).where(F.length("r") > 0)
    joined = forms.join(text, "case_id")
    return joined.groupBy("case_id").agg(F.max(F.exists("vs", lambda v: F.col("r").contains(v))).alias("hit")).where("not hit").select("case_id")


def wrong_explained(df: DataFrame, least: int = 5) -> DataFrame:
    """QA14: rationales that mention words of a wrong option more often than words of the right one."""
    long_words = lambda t: F.filter(F.split(comparable(t), " "), lambda w: F.length(w) >= least)
    # The words of an option are made once, not again for every word of the rationale.
    asked = F.transform("options", lambda o: F.struct(o["is_correct"].alias("c"), F.array_distinct(long_words(o["text"])).alias("words")))
    df = df.where(F.length("rationale") > 0).select("case_id", asked.alias("asked"), long_words("rationale").alias("said"))
    scored = F.transform("asked", lambda x: F.struct(x["c"].alias("c"), F.size(F.filter("said", lambda w: F.array_contains(x["words"], w))).alias("n")))
    right = F.coalesce(F.array_max(F.transform(F.filter(scored, lambda x: x["c"]), lambda x: x["n"])), F.lit(0))
    wrong = F.coalesce(F.array_max(F.transform(F.filter(scored, lambda x: ~x["c"]), lambda x: x["n"])), F.lit(0))
    return df.select("case_id", right.alias("right_hits"), wrong.alias("wrong_hits")).where("wrong_hits > right_hits")
