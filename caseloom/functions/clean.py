"""Cleaning and reading of explanations, narratives and options."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import comparable, norm_ws


def clean_explanation(c: Column) -> Column:
    """FN05: answer lead, references, page and image marks removed."""
    # Patterns of what goes, in order.
    patterns = ("(?i)^\\s*(ans(wer)?|jawaban)\\s*[:.-]+\\s*\\(?[a-e]\\)?[.,:)]*\\s*", "(?i)\\[?ref(erence)?s?\\s*[:.-][^\\n]*", "(?i)\\(?\\bpg?\\.?\\s*(no\\.?)?\\s*\\d+\\)?", "(?i)\\[?(image|figure|img)\\s*[:#]?\\s*\\d*\\]?")
    out = F.coalesce(c, F.lit(""))
    for p in patterns:
        out = F.regexp_replace(out, p, "")
    return norm_ws(out)


def clean_narrative(c: Column) -> Column:
    """FN06: page marks and running heads removed, broken lines joined."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "(?im)^\\s*(page|halaman)\\s+\\d+(\\s*(of|dari)\\s*\\d+)?\\s*$", "")
    out = F.regexp_replace(out, "(?m)^[ \\t]*[-_=]{3,}[ \\t]*$", "")
    out = F.regexp_replace(out, "(?<=[a-z,])-?\\n(?=[a-z])", " ")
    return norm_ws(out)


def expand_abbreviations(c: Column, table: dict[str, str]) -> Column:
    """FN06: abbreviations that stand as words, in the order of the table."""
    out = c
    for short, long in table.items():
        out = F.regexp_replace(out, f"\\b{short}\\b", long)
    return out


def smart_title(text: Column, years: Column, sex: Column, most: int = 60) -> Column:
    """FN09: demographics and the beginning of the complaint, cut at a word."""
    who = F.concat_ws(" ", F.concat(years.cast("string"), F.lit("y")), sex)
    rest = F.trim(F.regexp_extract(norm_ws(text), "^([^.?!\\n]*)", 1))
    cut = F.when(F.length(rest) <= most, rest).otherwise(F.regexp_extract(F.substring(rest, 1, most + 1), "^(.*)\\s", 1))
    return F.when(who == "", cut).otherwise(F.concat_ws(" • ", who, cut))


def language(c: Column, words: dict[str, list[str]]) -> Column:
    """FN14: the one language with marker words, en without any, mixed with several."""
    padded = F.concat(F.lit(" "), comparable(c), F.lit(" "))
    hit = F.filter(F.array(*[F.when(F.greatest(*[padded.contains(f" {w} ").cast("int") for w in ws]) > 0, F.lit(n)) for n, ws in words.items()]), lambda x: x.isNotNull())
    return F.when(F.size(hit) == 0, "en").when(F.size(hit) == 1, hit[0]).otherwise("mixed")


def normalize_options(options: Column) -> Column:
    """FN15: trimmed, own letter prefix removed, all-capital sets in title case."""
    bare = F.transform(options, lambda o: F.struct(o["id"].alias("id"), F.trim(F.regexp_replace(F.trim(o["text"]), "^\\(?([A-E])[.):]\\s*", "")).alias("text"), o["is_correct"].alias("is_correct")))
    capital = F.forall(bare, lambda o: (F.upper(o["text"]) == o["text"]) & o["text"].rlike("[A-Z]{4,}"))
    return F.when(F.size(bare) > 0, F.when(capital, F.transform(bare, lambda o: F.struct(o["id"].alias("id"), F.initcap(o["text"]).alias("text"), o["is_correct"].alias("is_correct")))).otherwise(bare)).otherwise(bare)


def option_review_reason(options: Column) -> Column:
    """FN15: why a normalised option list needs a look, or null."""
    return F.when(F.exists(options, lambda o: o["text"] == ""), "empty_option").when(F.exists(options, lambda o: F.lower(o["text"]).rlike("^(all|none) of the above")), "above_option")


def image_type(c: Column) -> Column:
    """FN17: kind of image a text speaks of; the first that fits."""
    # Kinds and their marks, in order.
    kinds = (("ecg", "\\b(ecg|ekg|electrocardiogram)\\b"), ("xray", "\\b(x-?ray|radiograph|rontgen)\\b"), ("ct", "\\bct[ -]?scan\\b"), ("mri", "\\bmri\\b"), ("ultrasound", "\\b(usg|ultrasound)\\b"), ("histology", "\\b(histolog|biops|smear)"), ("photo", "\\b(photo|picture|image|gambar)"))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        out = F.when(F.lower(c).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def search_key(*parts: tuple[Column, int]) -> Column:
    """FN18: parts, each cut to its length, joined in lower case; nulls are left out."""
    return F.lower(F.concat_ws(" ", *[F.substring(c, 1, n) for c, n in parts]))


def repair_distractors(distractors: Column, correct: Column, wrong: Column) -> Column:
    """FN19: the text under the key's id goes to the one wrong option without a text; maps that do not fit that stay."""
    missing = F.array_except(wrong, F.map_keys(distractors))
    fits = F.map_contains_key(distractors, correct) & (F.size(missing) == 1)
    others = F.map_filter(distractors, lambda k, _v: k != correct)
    return F.when(fits, F.map_concat(others, F.map_from_arrays(missing, F.array(distractors[correct])))).otherwise(distractors)


def canonical_units(c: Column) -> Column:
    """FN28: spellings of laboratory units."""
    # Spellings and the unit they mean.
    out = c
    for pattern, unit in (("(?i)\\bmg\\s*/\\s*dl\\b", "mg/dL"), ("(?i)\\bg\\s*/\\s*dl\\b", "g/dL"), ("(?i)\\bmmol\\s*/\\s*l\\b", "mmol/L"), ("(?i)\\bmeq\\s*/\\s*l\\b", "mEq/L"), ("(?i)\\biu\\s*/\\s*l\\b", "IU/L"), ("(?i)\\bmm\\s*hg\\b", "mmHg"), ("(?i)\\b(u|µ|mc)g\\s*/\\s*ml\\b", "µg/mL")):
        out = F.regexp_replace(out, pattern, unit)
    return out


@F.pandas_udf(StringType())
def decode_entities(c: pd.Series) -> pd.Series:
    """UD05: numeric and named entities, in Arrow batches; nulls stay."""
    return c.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)
