"""Connected components against a plain union, and the tables that a run writes."""

import numpy as np
import pytest

from caseloom.llm import components as module


def expected(pairs):
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k: find(k) for k in list(root)}


def graphs():
    rng = np.random.default_rng(5)
    names = rng.permutation(3000).tolist()
    yield "path", [(names[k], names[k + 1]) for k in range(400)], 4
    yield "star of the largest", [(5000, k) for k in range(600)], 2
    yield "stars", [(100 * k + j, 100 * k) for k in range(20) for j in range(1, 30)], 1
    yield "random", [tuple(x) for x in rng.integers(-1000, 1000, (900, 2)).tolist()], 3
    yield "loops and nulls", [(1, 1), (None, 2), (3, None), (7, 8), (8, 7), (7, 8)], 1
    yield "nothing", [], 1


@pytest.mark.parametrize(("name", "pairs", "rounds"), list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
@pytest.mark.parametrize("gathered", [1 << 18, 3])
def test_components(spark, monkeypatch, name, pairs, rounds, gathered):
    """Each round writes its edges once: rounds were confirmed by one more before, and stars took two."""
    written = []
    cut = module.cut
    monkeypatch.setattr(module, "cut", lambda df, table: written.append(table) or cut(df, table))
    monkeypatch.setattr(module, "GATHERED", gathered, raising=False)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    rows = module.components(edges).collect()
    assert {r.node: r.component for r in rows} == expected(pairs)
    assert len(rows) == len(expected(pairs))
    assert written.count("edges") <= rounds
