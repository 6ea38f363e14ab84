"""Answers that a slip tells apart: which meet, and how much is shuffled for them."""

import time

from caseloom.operators import contradictions


def shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(10_000)
    time.sleep(0.5)
    found = context.statusStore().executorList(True)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_words_of_answers_that_meet_nothing_stay_where_they_are(spark):
    words = lambda k: [f"word{(k * 7919 + j * 104729) % 1000003:06d}" for j in range(150)]
    rows = [(k, 1, words(k)) for k in range(60)]
    slip, gone, two, short = ([*words(3)] for _ in range(4))
    slip[70], gone[9], two[1], two[2], short[4] = slip[70] + "x", gone[9][:-1], "other1", "other2", "abc"
    rows += [(100, 1, slip), (101, 1, gone), (102, 1, two), (103, 1, short), (104, 2, slip), (105, 1, slip[:-1])]
    frame = spark.createDataFrame(rows, "id long, component long, words array<string>")
    before = shuffled(spark)
    got = sorted(map(tuple, contradictions.similar_answers(frame).collect()))
    assert got == [(3, 100), (3, 101)]
    assert shuffled(spark) - before < 3_000_000
