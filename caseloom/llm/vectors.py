"""Shared helpers for vectors: which take part, bounded samples, k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that codebooks are fitted on, at most.
SAMPLE = 10_000


def takes_part(v: Column) -> Column:
    """True for vectors without null or non-finite components that are not null, empty or zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def sample(rows: DataFrame, id_col: str, vec_col: str, n: int = SAMPLE) -> list[np.ndarray]:
    """The ``n`` first vectors by hash of their id, as matrices of one dimension each, most rows first."""
    got = rows.orderBy(F.xxhash64(F.lit(17), id_col), id_col).limit(n).select(vec_col).toArrow().column(0).to_pylist()
    by_dim: dict[int, list] = {}
    for v in got:
        by_dim.setdefault(len(v), []).append(v)
    return [np.array(x, dtype=np.float64) for _, x in sorted(by_dim.items(), key=lambda kv: -len(kv[1]))]


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0)


def k_means(x: np.ndarray, k: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Centroids of at most ``k`` clusters."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = max(1, min(k, len(x)))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near = squared_distances(x, centres).argmin(1)
        order = np.argsort(near, kind="stable")
        cuts = np.searchsorted(near[order], np.arange(k))
        filled = np.diff(np.append(cuts, len(x))) > 0
        sums = np.add.reduceat(x[order], np.minimum(cuts, len(x) - 1), axis=0)
        sizes = np.bincount(near, minlength=k)
        centres[filled] = sums[filled] / sizes[filled][:, None]
    return centres
