"""Review memory: fold of review logs into card states, and what is due (ST03 to ST05, TK03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import DECAY, FACTOR, MEMORY_W, retrievability


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), c))


def start() -> Column:
    """State of a card without reviews."""
    return F.struct(F.lit(5.0).alias("d"), F.lit(0.0).alias("s"), F.lit(0).alias("lapses"), F.lit(0.0).alias("last"))


def step(state: Column, review: Column) -> Column:
    """State after one review: a new card starts by its grade; a later one moves difficulty, stability and lapses."""
    w, g = MEMORY_W, review["grade"]
    first = F.element_at(F.array(*[F.lit(x) for x in w[:4]]), g)
    days = (review["at"] - state["last"]) / F.lit(86400.0)
    recall = F.pow(1 + F.lit(FACTOR) * days / state["s"], F.lit(DECAY))
    d = _clamp(state["d"] - F.lit(w[6] * w[7]) * (g - 3))
    grown = state["s"] * (1 + F.exp(F.lit(w[8])) * (11 - d) * F.pow(state["s"], F.lit(-w[9])) * (F.exp(F.lit(w[10]) * (1 - recall)) - 1))
    lapsed = F.greatest(F.lit(0.1), F.lit(w[11]) * F.pow(d, F.lit(-w[12])) * (F.pow(state["s"] + 1, F.lit(w[13])) - 1) * F.exp(F.lit(w[14]) * (1 - recall)))
    new = state["last"] == 0
    return F.struct(
        F.when(new, _clamp(F.lit(w[4]) - (g - 3) * F.lit(w[5]))).otherwise(d).alias("d"),
        F.when(new, first).when(g >= 3, grown).otherwise(lapsed).alias("s"),
        (state["lapses"] + F.when(~new & (g < 3), 1).otherwise(0)).alias("lapses"),
        review["at"].alias("last"),
    )


def fold_reviews(log: DataFrame) -> DataFrame:
    """ST03: log (user_hash, case_id, ts, seq, grade 1 to 4) to one state a card, reviews in order of time and seq.

    The fold is an ordered aggregate over one card's reviews inside the engine;
    other grades and null ids are dropped.
    """
    good = log.where(F.col("grade").between(1, 4) & F.col("case_id").isNotNull())
    item = F.struct(F.col("ts").cast("timestamp").cast("double").alias("at"), "seq", F.col("grade").cast("int").alias("grade"))
    cards = good.groupBy("user_hash", "case_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    folded = cards.withColumn("st", F.aggregate("r", start(), step))
    return folded.select("user_hash", "case_id", F.col("st.d").alias("difficulty"), F.col("st.s").alias("stability"), F.col("st.lapses").alias("lapses"), F.col("st.last").alias("last_review"), F.size("r").alias("reviews"))


def due_cards(state: DataFrame, now: float, threshold: float = 0.9, n: int = 20) -> DataFrame:
    """TK03: each user's ``n`` cards with the lowest recall below the threshold."""
    recall = retrievability(F.col("stability"), (F.lit(now) - F.col("last_review")) / 86400)
    order = Window.partitionBy("user_hash").orderBy("retrievability", "case_id")
    return state.withColumn("retrievability", recall).where(F.col("retrievability") < threshold).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("user_hash", "case_id", "retrievability", "place")


def reset_corrected(state: DataFrame, corrected: DataFrame) -> DataFrame:
    """ST04: cards of cases whose key was corrected start anew."""
    marks = corrected.select("case_id", F.lit(True).alias("_reset")).distinct()
    joined = state.join(marks, "case_id", "left")
    fresh = {"difficulty": 5.0, "stability": 0.0, "lapses": 0, "last_review": 0.0}
    return joined.withColumns({c: F.when(F.col("_reset"), F.lit(v)).otherwise(F.col(c)) for c, v in fresh.items()}).drop("_reset")


def memory_stats(state: DataFrame, now: float) -> DataFrame:
    """ST05: per user: cards reviewed, mean retention in percent, lapses, strength."""
    seen = state.where("last_review > 0 and stability > 0")
    recall = retrievability(F.col("stability"), (F.lit(now) - F.col("last_review")) / 86400)
    got = seen.groupBy("user_hash").agg(F.count(F.lit(1)).alias("reviewed"), F.avg(recall).alias("m"), F.sum("lapses").alias("lapses"))
    strength = F.when(F.col("m") > 0.85, "Strong").when(F.col("m") > 0.6, "Moderate").otherwise("Weak")
    return got.select("user_hash", "reviewed", F.floor(F.col("m") * 100 + 0.5).alias("retention"), "lapses", strength.alias("strength"))
