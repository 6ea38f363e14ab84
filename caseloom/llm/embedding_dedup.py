"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into two halves, each with its own codebook; pairs of
codewords form a grid of cells. A vector visits cells in order of the summed
distances of its halves (multi-sequence traversal) until the number of cells
that reaches the target recall: measured on a sample with neighbours placed
exactly at the threshold, the hardest case. Vectors found in a visited cell are
verified by cosine in double precision. A pair is found if either side visits
the other's cell, and is counted once. Equal vectors are one representative
with a count. A cell with many members is split into blocks, and a visitor goes
to each; many visitors of a block are dealt into slices, and its members go to
each; links are counted in place, and a block returns counts and a spanning
forest, never its pairs.

Only rows with equal, non-null labels and equal dimension are compared. Vectors
that are null, empty, zero or hold null or non-finite components link with
nothing. Repeated rows are linked as equal vectors; vectors that share an id are
one vector in components, and each row tells the larger number of links. A null
id is ignored in components and its row returned with its own null id. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut
from .vectors import k_means, matrix, sample, squared_distances, takes_part, unit

THRESHOLD = 0.98
TARGET_RECALL = 0.995
#: Members of a cell that are wanted on average, and of a block at most on average.
CELL_MEMBERS, BLOCK_MEMBERS = 512, 4096
#: Visitors of a block that one task compares, on average.
VISITORS = 16384
#: Codewords of a half at most; the sample that they are fitted on is five times as large.
MAX_WORDS = 2048


def multi_sequence(d1: np.ndarray, d2: np.ndarray, cells: int) -> list[int]:
    """The ``cells`` grid cells with the smallest d1[i] + d2[j], nearest first, as i * len(d2) + j."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    width, out = len(b), []
    heap, reached = [(a[0] + b[0], 0, 0)], [0] * len(a)  # reached: columns taken in each row
    while heap and len(out) < cells:
        _, i, j = heapq.heappop(heap)
        out.append(int(o1[i]) * width + int(o2[j]))
        reached[i] = j + 1
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


@dataclass
class MultiIndex:
    """Codebooks of the two halves and the number of cells a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def cells(self, x: np.ndarray, visits: int | None = None) -> list[list[int]]:
        """Cells visited by unit vectors; the first is the vector's own."""
        half = self.first.shape[1]
        d1, d2 = squared_distances(x[:, :half], self.first), squared_distances(x[:, half:], self.second)
        return [multi_sequence(p, q, visits or self.visits) for p, q in zip(d1, d2)]


def fit(x: np.ndarray, words: int, threshold: float, target: float) -> MultiIndex:
    """Codebooks on unit vectors ``x``; visits by neighbours placed at the threshold."""
    half = max(1, x.shape[1] // 2)
    index = MultiIndex(k_means(x[:, :half], words), k_means(x[:, half:], words), 1)
    rng = np.random.default_rng(3)
    base = x[rng.choice(len(x), min(len(x), 1000), replace=False)]
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    length = np.sqrt((noise * noise).sum(1, keepdims=True))
    noise = np.divide(noise, length, out=np.zeros_like(noise), where=length > 0)
    near = threshold * base + np.sqrt(1 - threshold**2) * noise
    total = len(index.first) * len(index.second)
    own, other = index.cells(base, total), index.cells(near, 1)
    back, home = index.cells(near, total), [c[0] for c in own]
    # Found if either of the two visits the other's cell.
    ranks = [min(a.index(b[0]), c.index(h)) + 1 for a, b, c, h in zip(own, other, back, home)]
    index.visits = int(np.quantile(ranks, target, method="higher"))
    return index


def _visits(rows: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """rows (rep, grp, copies, v) with the list of cells visited; the first is the home cell."""
    sent = rows.sparkSession.sparkContext.broadcast(indexes)  # bounded by MAX_WORDS and the sample's dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3).to_pylist()
            cells: list[list[int]] = [[0]] * len(vectors)
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(k)
            for dim, at in by_dim.items():
                if dim in sent.value:
                    for k, c in zip(at, sent.value[dim].cells(unit(np.array([vectors[k] for k in at], np.float64)))):
                        cells[k] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, "rep long, grp long, copies long, v array<double>, cells array<int>")


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``links`` connects; no more edges than documents."""
    edges: list[tuple[int, int]] = []
    todo_left = np.ones(len(left), bool)
    todo_right = links.any(axis=0)
    for k in range(len(left)):
        if not todo_left[k]:
            continue
        todo_left[k] = False
        front = links[k] & todo_right
        root = int(left[k])
        while front.any():
            todo_right &= ~front
            edges += [(root, int(x)) for x in right[front]]
            back = links[:, front].any(axis=1) & todo_left
            todo_left &= ~back
            edges += [(root, int(x)) for x in left[back]]
            front = (links[back].any(axis=0) & todo_right) if back.any() else np.zeros(len(right), bool)
    return [(a, b) for a, b in edges if a != b]


def _block_links(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        out_id, out_n, out_a, out_b = [], [], [], []
        keys = [table[c].to_numpy() for c in ("grp", "cell", "block", "slice")]
        order = np.lexsort(keys[::-1])
        table = table.take(pa.array(order))
        change = np.ones(len(order) + 1, bool)
        change[1:-1] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        cuts = np.flatnonzero(change)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = table.slice(lo, hi - lo)
            member = part["member"].to_numpy(zero_copy_only=False)
            if not member.any():
                continue
            ids, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
            x = unit(matrix(part["v"]))
            homes = part["home"].to_numpy()
            cells = part["cells"].to_pylist()
            at = np.flatnonzero(member)
            visited = {h: np.array([h in set(cells[k]) for k in at]) for h in np.unique(homes).tolist()}
            asking = np.flatnonzero(part["asks"].to_numpy(zero_copy_only=False))
            for first in range(0, len(asking), 2048):
                who = asking[first : first + 2048]
                near = x[who] @ x[at].T >= threshold
                # A pair whose two sides visit each other is counted where the smaller id visits.
                both = np.array([visited[h] for h in homes[who].tolist()])
                near &= ~both | (ids[who][:, None] < ids[at][None, :])
                near &= ids[who][:, None] != ids[at][None, :]
                for k in np.flatnonzero(near.any(1)):
                    out_id.append(int(ids[who[k]]))
                    out_n.append(int(copies[at][near[k]].sum()))
                for k in np.flatnonzero(near.any(0)):
                    out_id.append(int(ids[at[k]]))
                    out_n.append(int(copies[who][near[:, k]].sum()))
                for a, b in _forest(near, ids[who], ids[at]):
                    out_a.append(a)
                    out_b.append(b)
        n, m = len(out_id), len(out_a)
        return pa.table(
            {
                "rep": pa.array(out_id + [None] * m, pa.int64()),
                "n": pa.array(out_n + [None] * m, pa.int64()),
                "a": pa.array([None] * n + out_a, pa.int64()),
                "b": pa.array([None] * n + out_b, pa.int64()),
            }
        )

    return run


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, id_col="vec_id", vec_col="embedding", label_col="label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings``."""
    vec = F.col(vec_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("v"))
    usable = rows.where(takes_part(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = cut(usable.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    groups = classes.select("label", F.size("v").alias("d")).groupBy("label", "d").count().agg(F.count(F.lit(1)).alias("g"), F.sum("count").alias("n")).first()
    words = int(min(MAX_WORDS, max(4, np.ceil(np.sqrt((groups["n"] or 0) / max(1, groups["g"]) / CELL_MEMBERS)))))
    indexes = {m.shape[1]: fit(unit(m), words, threshold, target_recall) for m in sample(classes, "rep", "v")}
    visits = cut(
        _visits(classes.select("rep", F.xxhash64("label", F.size("v")).alias("grp"), "copies", "v"), indexes), "visits"
    ).withColumn("home", F.col("cells")[0])
    visited = visits.withColumn("cell", F.explode("cells")).withColumn("member", F.col("cell") == F.col("home"))
    members = F.count_if("member")
    sizes = visited.groupBy("grp", "cell").agg(
        F.ceil(members / F.lit(BLOCK_MEMBERS)).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / F.lit(VISITORS)).cast("int").alias("slices"), members.alias("m")
    )
    sizes = cut(sizes.where("m > 0").drop("m"), "cell-sizes")
    own = F.pmod(F.xxhash64(F.lit(9), "rep"), F.col("blocks")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    home = visited.where("member").join(sizes, ["grp", "cell"]).withColumn("block", own)
    # As a member a vector is in all slices of its block; it asks in the first, and as a visitor of the other blocks in one slice.
    as_member = home.withColumn("slice", F.explode(every("slices"))).withColumn("asks", F.col("slice") == 0)
    guests = visited.join(sizes, ["grp", "cell"]).withColumn("block", F.explode(every("blocks"))).where(~F.col("member") | (F.col("block") != own))
    as_guest = guests.withColumn("member", F.lit(False)).withColumn("slice", F.pmod(F.xxhash64(F.lit(10), "rep"), F.col("slices")).cast("int")).withColumn("asks", F.lit(True))
    wanted = ["grp", "cell", "block", "slice", "rep", "copies", "home", "member", "asks", "cells", "v"]
    probes = as_member.select(*wanted).unionByName(as_guest.withColumn("cells", F.lit(None).cast("array<int>")).select(*wanted))
    task = F.xxhash64("grp", "cell", "block", "slice")
    found = cut(
        probes.withColumn("task", task).groupBy("task").applyInArrow(_block_links(threshold), "rep long, n long, a long, b long"),
        "vector-links",
    )
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    member = usable.join(classes, ["label", "v"]).select("vec_id", "rep", "copies").join(counts, "rep", "left")
    per_id = member.select("vec_id", "rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    per_id = cut(per_id, "vector-members").dropDuplicates(["vec_id", "rep"])
    edges = found.where("a is not null").select("a", "b").unionByName(per_id.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    comps = components(edges).withColumnRenamed("node", "vec_id")
    links = per_id.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    return (
        rows.select("vec_id")
        .join(links, "vec_id", "left")
        .join(comps, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
