"""Quality counts against plain Python; the estimation against a plain loop; planted junk and sound texts."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from caseloom.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, words string, t int, lines int, quality double"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


def corpus():
    rng = np.random.default_rng(8)
    good = [prose(rng, int(n)) + "." for n in rng.integers(60, 400, 120)]
    junk = [" | ".join(prose(rng, 120).split()) for _ in range(6)] + [" ".join(w + "$$$" for w in prose(rng, 150).split()) for _ in range(6)]
    junk += ["BUY NOW!! " * 60 for _ in range(3)] + ["\n".join([prose(rng, 9)] * 20) for _ in range(3)]
    odd = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "of of of of", "x\ny\nx\n\n \nx", "ü ß <tag> |", "\x1c a\x85b c", "😀 😀 😀 😀", prose(rng, 20000)]
    return good, junk, odd


def test_counts_and_verdicts(spark):
    good, junk, odd = corpus()
    texts = [*good, *junk, *odd, good[0]]
    rows = [(k if k != 5 else None, t, "w", 1, 2, 0.5) for k, t in enumerate(texts)]
    got = qr.quality_digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for k, t in enumerate(texts):
        r = by_id[k if k != 5 else None]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t)
        n, _, _, _, repeated = counts(t)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.base_failed and r.kept)
    assert all(by_id[k if k != 5 else None].kept for k in range(len(good)))
    assert not any(by_id[len(good) + k].kept for k in range(len(junk)))


def test_estimation_against_a_loop(spark):
    rng = np.random.default_rng(9)
    names = qr.vote_names()
    truth = rng.random(500) < 0.8
    votes = np.where(rng.random((500, len(names))) < 0.85, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    worth = qr.estimate(spark.createDataFrame(votes.tolist(), [*names]).select(*[F.col(n).cast("int") for n in names]), rounds=7)
    up, down = (votes == 1).sum(1), (votes == -1).sum(1)
    p = (up + 1) / (up + 3 * down + 2)
    for k in range(7):
        if k:
            odds = np.full(500, share / (1 - share))
            for j in range(len(names)):
                odds *= np.where(votes[:, j] == 1, a[j] / (1 - b[j]), np.where(votes[:, j] == -1, (1 - a[j]) / b[j], 1))
            p = odds / (1 + odds)
        share = (p.sum() + 1) / (500 + 2)
        cast = votes != 0
        a = (((votes == 1) * p[:, None]).sum(0) + qr.ON_GOOD[0]) / ((cast * p[:, None]).sum(0) + qr.ON_GOOD[1])
        b = (((votes == -1) * (1 - p)[:, None]).sum(0) + qr.ON_BAD[0]) / ((cast * (1 - p)[:, None]).sum(0) + qr.ON_BAD[1])
    assert np.allclose([worth.share, *worth.on_good, *worth.on_bad], [share, *a, *b])
    assert abs(worth.share - truth.mean()) < 0.05


def test_empty(spark):
    assert qr.quality_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_built_in_functions(spark):
    plan = qr.quality_digest(spark.createDataFrame([(1, "a b", "", 1, 1, 0.1)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
