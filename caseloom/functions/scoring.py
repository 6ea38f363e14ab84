"""Scores of single records: validation, quality, memory and panel items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import comparable

# Weights of the six validation layers; `localized` counts 0.30 in the local exam context.
LAYER_WEIGHTS = {"source_authority": 0.25, "expert_verified": 0.25, "guideline_aligned": 0.20, "localized": 0.15, "reasoning_chain": 0.10, "temporal_validity": 0.05}
LOCAL_CONTEXT, LOCAL_WEIGHT = "UKMPPD", 0.30
# Weights and decay of the memory model.
MEMORY_W = (0.4, 0.6, 2.4, 5.8, 4.93, 0.94, 0.86, 0.01, 1.49, 0.14, 0.94, 2.18, 0.05, 0.34, 1.26, 0.29, 2.61)
DECAY = -0.5
FACTOR = 0.9 ** (1 / DECAY) - 1


def validation_score(layers: dict[str, Column], context: Column) -> tuple[Column, Column]:
    """FN11: (weighted mean to one decimal, flags)."""
    local = F.when(context == LOCAL_CONTEXT, F.lit(LOCAL_WEIGHT)).otherwise(F.lit(LAYER_WEIGHTS["localized"]))
    weight = {n: (local if n == "localized" else F.lit(w)) for n, w in LAYER_WEIGHTS.items()}
    total, mass = F.lit(0.0), F.lit(0.0)
    for n in LAYER_WEIGHTS:
        total, mass = total + layers[n] * weight[n], mass + weight[n]
    flags = F.array(
        F.when((layers["localized"] <= 2) & (context == LOCAL_CONTEXT), F.lit("NEEDS_LOCAL_REVIEW")),
        F.when(layers["reasoning_chain"] <= 1, F.lit("NO_EXPLANATION")),
        F.when(layers["source_authority"] <= 1, F.lit("UNVERIFIED_SOURCE")),
    )
    return F.round(total / mass, 1), F.filter(flags, lambda x: x.isNotNull())


def quality_score(has_answer: Column, rationale: Column, truncated: Column, n_options: Column, stem: Column, demographics: Column, tagged: Column, review: Column) -> Column:
    """FN12: 0 to 100 by eight weighted checks."""
    # Points of each check.
    checks = [
        (has_answer, 25), (F.length(rationale) > 50, 25), (~F.coalesce(truncated, F.lit(False)), 15), (n_options.between(4, 5), 10),
        (F.length(stem) > 100, 10), (demographics, 5), (tagged, 5), (~F.coalesce(review, F.lit(False)), 5),
    ]
    total = F.lit(0)
    for ok, points in checks:
        total = total + F.when(ok, F.lit(points)).otherwise(F.lit(0))
    return total


def resolve_option(options: Column, raw: Column) -> Column:
    """FN16: id of the option meant by ``raw``: its id, a letter, OP and a letter, a position from 1, or its text."""
    said = F.upper(F.trim(raw))
    letter = F.regexp_extract(said, "^(?:OP)?([A-Z])$", 1)
    ids = F.transform(options, lambda o: F.upper(o["id"]))
    place = F.coalesce(
        F.nullif(F.array_position(ids, said), F.lit(0)),
        F.nullif(F.array_position(ids, letter), F.lit(0)),
        F.when(letter != "", F.ascii(letter) - 64),
        F.when(said.rlike("^[0-9]{1,2}$"), said.cast("int")),
        F.nullif(F.array_position(F.transform(options, lambda o: comparable(o["text"])), comparable(raw)), F.lit(0)),
    )
    return F.get(options, (place - 1).cast("int"))["id"]


def retrievability(stability: Column, days: Column) -> Column:
    """FN21: recall after ``days``, held between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(1 + F.lit(FACTOR) * days / stability, F.lit(DECAY))))


def recall_probability(stability: Column, days: Column, n_options: Column) -> Column:
    """FN22: recall with guessing as the floor; a card never seen is guessed."""
    guess = 1 / F.greatest(n_options, F.lit(1)).cast("double")
    seen = (F.coalesce(stability, F.lit(0.0)) > 0) & days.isNotNull()
    return F.when(seen, F.greatest(guess, retrievability(stability, days))).otherwise(guess)


def panel_score(votes: Column, chosen: Column) -> Column:
    """FN23: votes of the chosen option over the most votes; votes is an array of whole numbers."""
    most = F.array_max(votes)
    return F.when(F.coalesce(most, F.lit(0)) > 0, F.coalesce(F.get(votes, chosen), F.lit(0)) / most).otherwise(F.lit(0.0))


def flip_votes(votes: Column, direction: Column) -> Column:
    """FN24: votes mirrored where the stated direction (-1, 1) contradicts the side of the peak."""
    peak = F.array_position(votes, F.array_max(votes)) - 1 - F.floor((F.size(votes) - 1) / 2)
    return F.when(F.signum(peak.cast("double")) * direction < 0, F.reverse(votes)).otherwise(votes)
