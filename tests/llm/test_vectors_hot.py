"""Hot cells and lists, few members near a query, odd dimensions; the chain of classifiers against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from caseloom.llm import ann, embedding_dedup, toxicity


def test_hot_cell_in_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(embedding_dedup, "VISITORS", 40)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 12))
    x[:120] = x[0] + 0.1 * rng.standard_normal((120, 12))
    rows = [(k, x[k].tolist(), 1, 5) for k in range(300)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, slice int").repartition(3), target_recall=1.0).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = u @ u.T >= 0.98
    np.fill_diagonal(links, False)
    assert links.sum() > 1000
    assert sum(r.n_links for r in got.values()) >= 0.99 * links.sum()
    assert all(got[k].n_links <= links[k].sum() for k in range(300))


def test_default_recall(spark):
    """Links at the default target, on clusters whose members are just at the threshold."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 32))
    x = np.repeat(centres, 8, axis=0)
    x += 0.1 * np.linalg.norm(x, axis=1)[:, None] * rng.standard_normal(x.shape) / np.sqrt(32)
    rows = [(k, x[k].tolist(), 1) for k in range(len(x))]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = u @ u.T >= 0.98
    np.fill_diagonal(links, False)
    assert sum(r.n_links for r in got.values()) >= 0.98 * links.sum() > 1000


def test_every_query_gets_twenty(spark, monkeypatch):
    """Queries far from all others, in lists of few members; split lists; a dimension of its own; a repeated query id."""
    monkeypatch.setattr(ann, "BLOCK_MEMBERS", 50)
    monkeypatch.setattr(ann, "SLICE_QUERIES", 3)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 8))
    x[:5] *= 100
    rows = [(k, x[k].tolist(), 0) for k in range(600)] + [(1000, [1.0, 2.0], 0), (1001, [2.0, 1.0], 0), (20, x[21].tolist(), 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, slice int").repartition(3)
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [*range(0, 600, 20), 1000]
    assert len(got.pop(1000)) == 1
    assert all(sorted(r for r, _, _ in found) == list(range(1, 21)) for found in got.values())
    query = min(x[20].tolist(), x[21].tolist())
    assert all(abs(score - x[v] @ query) < 1e-9 for _, v, score in got[20] if v != 20)


def test_chain_against_a_plain_loop():
    rng = np.random.default_rng(3)
    chain = toxicity.Chain(["a", "b", "c"], np.arange(40, dtype=np.uint64), rng.standard_normal((3, 40)), np.tril(rng.standard_normal((3, 3)), -1), rng.standard_normal(3))
    texts = [np.unique(rng.integers(0, 40, n)) for n in (0, 1, 5, 30)]
    got = chain.probabilities(4, np.repeat(np.arange(4), [len(t) for t in texts]), np.concatenate(texts).astype(int))
    for k, features in enumerate(texts):
        before = []
        for c in range(3):
            z = chain.bias[c] + sum(chain.weights[c][f] for f in features) + sum(w * p for w, p in zip(chain.earlier[c], before))
            before.append(1 / (1 + np.exp(-z)))
        assert np.allclose(got[k], before)
