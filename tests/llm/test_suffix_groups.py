"""Passages that many documents share, against a plain loop over all windows of 50 words."""

import numpy as np
import pytest

from caseloom.llm import suffix_dedup
from caseloom.llm.words import split_words


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 6))) for _ in range(n))


@pytest.fixture
def small_batches(spark):
    """As where a head has many more rows than a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def windows(texts):
    seen = {}
    for k, t in texts.items():
        w = t.split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(k)
    return seen


def check(spark, texts):
    """Words in spans, and words in spans that repeat an earlier document, are those of the plain loop."""
    seen = windows(texts)
    truth, got = ({k: np.zeros((2, len(t.split())), bool) for k, t in texts.items()} for _ in range(2))
    for k, t in texts.items():
        w = t.split()
        for i in range(len(w) - 49):
            ids = seen[tuple(w[i : i + 50])]
            truth[k][0, i : i + 50] |= len(ids) > 1
            truth[k][1, i : i + 50] |= min(ids) < k
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for s in suffix_dedup.repeated_passages(docs).collect():
        got[s.doc_id][int(s.repeats_earlier), s.start : s.stop] = True
    wrong = [k for k in texts if (got[k] != truth[k]).any()]
    assert not wrong, (len(wrong), wrong[:10])


def test_only_the_smallest_id_keeps_a_passage_of_many_documents(spark):
    rng = np.random.default_rng(5)
    passage = prose(rng, 55)
    check(spark, {int(k): f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for k in rng.permutation(400)})


def test_match_behind_boilerplate_of_many_documents(spark, small_batches):
    rng = np.random.default_rng(6)
    passages = []
    while len(passages) < 12:  # passages whose kept suffixes all lie in the boilerplate; not every boilerplate has them
        boiler = prose(rng, 36)
        made = [f"{prose(rng, 14)} {boiler}" for _ in range(30)]
        passages = [p for p in made if suffix_dedup.kept_suffixes(split_words([p.encode()]), 50, 35)[2].min() >= 14]
    texts = {k: f"{prose(rng, 20)} {boiler} {prose(rng, 20)}" for k in range(2000)}
    for passage in passages[:12] * 2:
        texts[len(texts)] = f"{passage} {prose(rng, 20)}"  # no context before, which could keep another suffix
    check(spark, texts)


def test_long_document_with_one_head_many_times(spark, small_batches):
    rng = np.random.default_rng(7)
    boiler = prose(rng, 40)
    passage = f"{prose(rng, 12)} {boiler} {prose(rng, 8)}"
    texts = {k: f"{prose(rng, 10)} {passage} {prose(rng, 10)}" for k in (0, 2)}
    texts[1] = " ".join(f"{prose(rng, 3)} {boiler}" for _ in range(200))
    check(spark, texts)


def test_passage_three_hundred_times_in_one_document(spark):
    rng = np.random.default_rng(8)
    passage = prose(rng, 60)
    check(spark, {1: f"{passage} {prose(rng, 30)}", 2: f"{prose(rng, 30)} {passage}", 3: " ".join([passage] * 300), 4: f"{passage} {passage}"})


def test_very_many_equal_documents(spark):
    rng = np.random.default_rng(9)
    text = prose(rng, 90)
    check(spark, {**{k: text for k in range(5000)}, 5000: f"{prose(rng, 40)} {text}", 5001: prose(rng, 80)})


def test_texts_that_share_an_id(spark):
    rng = np.random.default_rng(10)
    passage, alone = prose(rng, 60), prose(rng, 80)
    rows = [(1, f"{prose(rng, 10)} {passage}", 7), (5, f"{passage} tail of it", 8), (5, alone, 9), (6, prose(rng, 70), 3), (6, passage, 4), (8, alone.upper(), 1), (8, alone.upper(), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut_spans int").repartition(2)
    spans = suffix_dedup.repeated_passages(docs)
    left = sorted((r.doc_id, len(r.text.split())) for r in suffix_dedup.cut_repeats(docs, spans).collect())
    # Texts that share an id count as later: the text of 5 that equals both rows of 8 goes.
    assert left == [(1, 70), (5, 3), (6, 70), (8, 80), (8, 80)]
    assert suffix_dedup.cut_repeats(docs, spans).columns == docs.columns
