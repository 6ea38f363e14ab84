"""The n-gram join on families of texts around the threshold, against all pairs."""

import numpy as np
import pytest

from caseloom.llm import ngram_join


def family(rng, size, words, changed):
    """Texts that each differ from one original in about ``changed`` words."""
    base = [f"w{k}" for k in rng.integers(0, 500, words)]
    out = []
    for _ in range(size):
        text = list(base)
        for at in rng.integers(0, words, rng.integers(0, changed + 1)):
            text[at] = f"v{rng.integers(0, 40)}"
        out.append(text)
    return out


def expected(texts, n, percent):
    sets = [{tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in texts]
    root = list(range(len(texts)))

    def find(k):
        return k if root[k] == k else find(root[k])

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(texts))], links


@pytest.mark.parametrize(("n", "percent", "pairs"), [(5, 80, 2), (4, 85, 1000)])
def test_families(spark, monkeypatch, n, percent, pairs):
    """With 1000 pairs an entry the blocks follow the first round at once."""
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ENTRY", pairs)
    monkeypatch.setattr(ngram_join, "ANCHOR_ROWS", 7)
    monkeypatch.setattr(ngram_join, "SIDE_DOCS", 8)
    rng = np.random.default_rng(n)
    texts = []
    for size, words, changed in ((40, 120, 1), (60, 150, 3), (60, 200, 6), (30, 90, 4), (25, 400, 12)):
        texts += family(rng, size, words, changed)
    mixed = texts[0][:100]  # documents of a common passage that do not link, and a chain in which neighbours link
    texts += [mixed + [f"u{k}_{j}" for j in range(30)] for k in range(20)]
    chain = [f"c{k}" for k in range(400)]
    texts += [chain[3 * k : 3 * k + 120] for k in range(40)]
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    truth, links = expected(texts, n, percent)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs, n, percent).collect()}
    assert links > 500
    assert [got[k] for k in range(len(texts))] == truth
