"""Contradicting answers to one question (DD15 to DD18)."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable


def fingerprint_words(cases: DataFrame, most: int = 5) -> DataFrame:
    """case_id, pos, tokens (distinct, over three letters) and the ``most`` longest of them, sorted."""
    words = F.array_distinct(F.filter(F.split(comparable("question"), " "), lambda w: F.length(w) > 3))
    ranked = F.array_sort(F.transform("tokens", lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    top = F.array_sort(F.transform(F.slice(ranked, 1, most), lambda x: x["w"]))
    return cases.select("case_id", "pos", words.alias("tokens")).withColumn("words", top)


def contradiction_keys(cases: DataFrame, most: int = 5, choose: int = 4) -> DataFrame:
    """DD15: every choice of four of a case's five longest words; tokens ride along with the first, from a table in the checkpoint folder."""
    from ..sources.io import ensure_checkpoint_dir

    spark = cases.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/caseloom/worded-{uuid.uuid4().hex}"
    fingerprint_words(cases, most).where(F.size("words") == most).write.parquet(path)  # packed, where checkpoint() is not
    picks = [F.array_join(F.array(*[F.col("words")[k] for k in c]), "_") for c in combinations(range(most), choose)]
    rows = spark.read.parquet(path).select("case_id", "pos", "tokens", F.posexplode(F.array(*picks)).alias("nth", "key"))
    return rows.select("case_id", "pos", F.when(F.col("nth") == 0, F.col("tokens")).alias("tokens"), "key")


def contradiction_edges(keys: DataFrame, overlap: float = 0.6) -> DataFrame:
    """DD16: each bucket's first case against every other member, where enough tokens are shared.

    The star keeps a bucket of n at n comparisons; its anchor comes from an
    aggregate, so a large bucket is no single task. Only ids travel with the
    keys; tokens meet the distinct pairs afterwards, once a case (rows without
    tokens stand beside one that has them).
    """
    narrow = keys.select("key", "case_id", "pos")
    anchors = narrow.groupBy("key").agg(F.min_by("case_id", "pos").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = narrow.join(anchors, "key").where("case_id <> a").select("a", F.col("case_id").alias("b")).distinct()
    tokens = keys.where("tokens is not null").groupBy("case_id").agg(F.min_by("tokens", "pos").alias("tokens"))
    one, two = (tokens.select(F.col("case_id").alias(k), F.col("tokens").alias(f"{k}t")) for k in "ab")
    shared = F.size(F.array_intersect("at", "bt")) / F.least(F.size("at"), F.size("bt"))
    return pairs.join(one, "a").join(two, "b").where(shared >= overlap).select("a", "b")


def connected(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """DD17: (case_id, component) by rounds of smallest neighbours and pointer jumps; isolated cases are absent.

    Lineage is cut by checkpoint() into the session's checkpoint folder.
    """
    from ..sources.io import ensure_checkpoint_dir

    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")).checkpoint()
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("n"))
        met = labels.join(near, labels["v"] == near["a"]).select("v", F.least("c", "n").alias("c"), F.col("c").alias("old"))
        jump = met.select(F.col("v").alias("jv"), F.col("c").alias("jc"))
        after = met.join(jump, met["c"] == jump["jv"]).select("v", F.col("jc").alias("c"), "old").checkpoint()
        changed = after.where("c <> old").limit(1).count()
        labels = after.select("v", "c")
        if not changed:
            return labels.select(F.col("v").alias("case_id"), F.col("c").alias("component"))


def similar_answers(answers: DataFrame) -> DataFrame:
    """a, b: ids of answers (id, component, words) of a component that a slip tells apart: one word of four letters or more, by one letter.

    The rest of the answer and the word's place are a key; a word whose key no
    other answer has is out. The others meet by a deletion neighbourhood: a word
    is left out a letter at a time, and whole, so that words one edit apart have
    a form in common. Only ids and hashes travel with keys and forms; the words
    meet the distinct pairs afterwards and decide.
    """
    long = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: F.length(F.get("words", k)) >= 4)
    placed = answers.where(F.size("words") >= 2).select("id", "component", "words", F.explode(long).alias("at"))
    rest = F.xxhash64("component", F.size("words"), "at", F.array_join(F.transform("words", lambda w, i: F.when(i == F.col("at"), "").otherwise(w)), " "))
    slots = placed.select("id", "at", rest.alias("rest"))
    shared = slots.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rest")
    met = slots.join(shared, "rest", "left_semi").join(answers.select("id", "words"), "id").select("id", "rest", F.get("words", F.col("at")).alias("word"))
    less = F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.concat(F.substr("word", F.lit(1), k - 1), F.substr("word", k + 1, F.length("word"))))
    keyed = met.select("id", F.explode(F.array_distinct(F.transform(F.concat(F.array("word"), less), lambda f: F.xxhash64("rest", f)))).alias("key"))
    pairs = keyed.alias("x").join(keyed.alias("y"), "key").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    one, two = (answers.select(F.col("id").alias(k), F.col("component").alias(f"{k}c"), F.col("words").alias(f"{k}w")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b").where((F.col("ac") == F.col("bc")) & (F.size("aw") == F.size("bw")))
    other = F.filter(F.arrays_zip("aw", "bw"), lambda p: p["aw"] != p["bw"])
    p = F.get(other, F.lit(0))
    near = (F.length(p["aw"]) >= 4) & (F.length(p["bw"]) >= 4) & (F.levenshtein(p["aw"], p["bw"], 1) == 1)
    return both.where((F.size(other) == 1) & near).select("a", "b")


def answer_clusters(members: DataFrame) -> DataFrame:
    """DD18: for rows (component, pos, case_id, answer): greedy clusters of answers in input order.

    An answer that no head before it is similar to is a head. Answers that have
    none undecided before them decide in rounds what comes behind; those
    without a similar one are heads at once. A component with two heads or more
    is a contradiction. Equal answers are one; no component is one task.
    """
    from ..sources.io import ensure_checkpoint_dir
    from .ids import dense_numbers

    ensure_checkpoint_dir(members.sparkSession)
    distinct = members.groupBy("component", comparable("answer").alias("answer")).agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n")).where("answer <> ''")
    numbered = dense_numbers(distinct, ["pos", "answer", "component"], "id").withColumn("words", F.split("answer", " ")).checkpoint()
    edges = similar_answers(numbered).checkpoint()  # a is before b
    joined = None
    while not edges.isEmpty():
        later = edges.select(F.col("b").alias("id")).distinct()
        heads = edges.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti")
        taken = edges.join(heads.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct().checkpoint()
        joined = taken if joined is None else joined.unionByName(taken)
        gone = heads.unionByName(taken)
        edges = edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").checkpoint()
    found = numbered.select("id", "component", "n").withColumn("head", F.lit(1))
    if joined is not None:
        found = numbered.select("id", "component", "n").join(joined.withColumn("_in", F.lit(True)), "id", "left").withColumn("head", F.when(F.col("_in"), 0).otherwise(1))
    out = found.groupBy("component").agg(F.sum("n").alias("n_cases"), F.sum("head").alias("n_clusters"))
    return out.withColumn("contradiction", F.col("n_clusters") > 1)
