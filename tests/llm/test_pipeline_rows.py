"""The middle stages of the pipeline on planted documents, against plain loops; rows that share an id."""

import re

import numpy as np

import corpus_pipeline


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 6))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row long").repartition(3)


def texts_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_rows_that_share_an_id(spark):
    rng = np.random.default_rng(0)
    a, b, c = prose(rng, 90), prose(rng, 90), prose(rng, 90)
    kept = corpus_pipeline.one_of_each_group(spark, frame(spark, [(1, a), (1, a), (2, b), (2, c), (3, f"{c} more"), (4, b), (5, "")]), "")
    assert texts_of(kept) == [(1, a), (3, f"{c} more"), (4, b), (5, "")]


def test_stages_against_plain_loops(spark):
    """Near copies, then a passage of 55 words in a hundred documents, then secrets."""
    rng = np.random.default_rng(1)
    passage = prose(rng, 55)
    rows = {k: f"{prose(rng, 30)} {passage} {prose(rng, 60)}" for k in range(100)}
    rows |= {200 + k: prose(rng, 150) for k in range(20)}
    rows |= {300 + k: f"{rows[200 + k]} {prose(rng, 10)}" for k in range(20)}
    rows[400] = f"{prose(rng, 20)} password = hunter2hunter {prose(rng, 20)}"
    docs = frame(spark, rows.items())
    docs = corpus_pipeline.one_of_each_group(spark, docs, "")
    expect = {k: t for k, t in rows.items() if not 300 <= k < 400}
    assert texts_of(docs) == sorted(expect.items())
    docs = corpus_pipeline.cut_repeated_passages(spark, docs, "")
    seen = {}
    for k in sorted(expect):
        w = expect[k].split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), k)
    cut = {}
    for k, t in expect.items():
        w = t.split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if seen[tuple(w[i : i + 50])] < k:
                gone[i : i + 50] = True
        cut[k] = " ".join(np.array(w)[~gone])
    assert texts_of(docs) == sorted(cut.items())
    docs = corpus_pipeline.mask_secrets(spark, docs, "")
    masked = {k: re.sub(r"password = hunter2hunter", "[assign]", t) for k, t in cut.items()}
    assert texts_of(docs) == sorted(masked.items()) and docs.columns[-1] == "row"
