"""Connected components by rounds of large stars and contraction within tasks.

A round maps the larger neighbours of each vertex to its smallest one; then each
task joins what its own edges connect, and the smaller neighbours of a vertex
are mapped to the smallest of them. A task keeps one edge a vertex, so a vertex
with very many edges has no more smaller neighbours than there are tasks; joins
are on plain columns and are split like any skewed join key. The rounds end when
all edges are stars. Neighbours of a component's smallest vertex stay so, and
each round makes all their neighbours such, so the rounds do end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, discard

#: Edges that a task gathers before it contracts them with those it has.
GATHERED = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex it is connected with) for all vertices but the smallest ones."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    least = np.arange(len(nodes))
    while len(x):
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (further := least[least] < least).any():
            least[further] = least[least[further]]
        x, y = least[x], least[y]
        x, y = x[x != y], y[x != y]
    rest = np.flatnonzero(least < np.arange(len(nodes)))
    return nodes[rest], nodes[least[rest]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (hi, lo) that connect what each task's edges connect: a star for each of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi = lo = np.empty(0, np.int64)
        more: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            more.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size > max(GATHERED, len(hi)):
                hi, lo = stars(*(np.concatenate(c) for c in zip((hi, lo), *more)))
                more, size = [], 0
        hi, lo = stars(*(np.concatenate(c) for c in zip((hi, lo), *more)))
        yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])

    return edges.select("hi", "lo").mapInArrow(run, "hi long, lo long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); the component is its smallest node.

    Loops and null ends are ignored; without edges the result is empty. A task holds its own edges' vertices.
    """
    pairs = edges.select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo")).where("hi <> lo")
    while True:
        small = contracted(pairs).groupBy("hi").agg(F.min("lo").alias("lo"), F.collect_set("lo").alias("los"))
        ends = F.explode(F.array_append("los", F.col("hi"))).alias("hi")
        now = cut(small.select(ends, "lo").where("hi <> lo"), "edges")
        ends = F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("v")))
        # In stars a node has one edge to a smaller one, or only edges to larger ones.
        found = now.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.min("e.v").alias("component"), (F.min("e.v") < F.max("e.v")).alias("open"))
        found = cut(found, "components")
        if found.where("open").isEmpty():
            discard(now)
            return found.select("node", "component")
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("node"), F.col("hi").alias("v")))
        large = both.join(found.select("node", "component"), "node").where("v > node")
        pairs = large.select(F.col("v").alias("hi"), F.col("component").alias("lo"))
