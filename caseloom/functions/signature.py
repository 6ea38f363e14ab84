"""Signatures that bring records of the same question together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alnum

# Words too common to identify a question.
STOP_WORDS = ("about", "after", "before", "being", "could", "following", "their", "there", "these", "those", "which", "would", "patient", "presents")


def semantic_sig(text: Column, keep: int = 8, least: int = 4) -> Column:
    """DD01: the longest distinct words of more than four letters, sorted; null for short or poor texts.

    Ties in length keep the word seen first.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " ")), " ")
    words = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 4) & ~w.isin(*STOP_WORDS)))
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    top = F.array_sort(F.transform(F.slice(ranked, 1, keep), lambda x: x["w"]))
    # The one-element array binds the words, which would be worked out for each use otherwise.
    joined = F.transform(F.array(top), lambda t: F.when(F.size(t) >= least, F.array_join(t, "_")))[0]
    return F.when(F.length(text) >= 30, joined)


def options_hash(texts: Column, chars: int = 30, least: int = 3) -> Column:
    """DD02: beginnings of the option texts, in an order of their own."""
    short = F.transform(texts, lambda t: F.substring(alnum(t), 1, chars))
    return F.array_join(F.array_sort(F.filter(short, lambda t: F.length(t) > least)), "_")


def option_fingerprint(texts: Column, chars: int = 30) -> Column:
    """JN01: sorted beginnings of lower-cased option texts."""
    return F.array_join(F.array_sort(F.transform(texts, lambda t: F.substring(F.trim(F.lower(t)), 1, chars))), "|")
