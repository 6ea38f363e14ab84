"""Merkle manifest of a dataset: one root digest, and a proof for every row.

Every row is a leaf. Within a tree (the rows of one source) leaves are ranked,
and a node carries the interval of ranks [lo, hi) that it covers: at level L
the node of bucket k covers k * 3^L and so on. The subroots of all sources are
the leaves of one further tree, whose top is the root.

* Upwards, a task takes whole buckets of 3^6 leaves and makes the nodes of six
  levels; the tops of those buckets are the leaves of the next band. So a
  source with a third of all rows is as many tasks as its size asks for.
* Downwards, members and nodes of a band meet by their level's bucket. A node
  is an ancestor where its interval contains the member's, and what lies in
  the parent's interval outside the own one are the siblings. The path of a
  bucket's top comes from the band above, and is joined once a bucket.

A path is an array of (before, after): the digests of the left and of the right
siblings, level by level from the leaf to the root. Folding a digest over it
gives the root; both are column expressions.

Null values are `-`; a null source is a tree of its own, before all others.
Null ids come first in their source; rows of equal id are ordered by digest, so
that repeated rows make a leaf each and the result does not depend on how the
rows lie. Long texts are hashed where they are read and travel no further. An
empty table gives no rows. Other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ids import dense_numbers
from .scratch import cut

FANOUT = 3
#: Levels that one task makes; a bucket of a band has FANOUT ** BAND members.
BAND = 6
#: Members that a task takes, about.
TASK = 2048
#: Ranks of a source that meet its row in one join key.
CHUNK = 65536

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"
_NODE = "tree long, level int, lo long, hi long, n long, digest string"
_MEMBER = "tree long, place long, n long, digest string, doc_id long, other string"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    said = value.cast("string")
    return F.when(said.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that ``digest`` leads to along ``path``."""
    return F.aggregate(path, digest, lambda so_far, step: F.sha2(F.concat(step["before"], so_far, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _grow(base: int) -> Callable[[pa.Table], pa.Table]:
    """Nodes of the levels above ``base`` from whole buckets of members (tree, place, n, digest)."""

    def run(table: pa.Table) -> pa.Table:
        tree, place, n = (table[c].to_numpy() for c in ("tree", "place", "n"))
        order = np.lexsort((place, tree))
        tree, place, n = tree[order], place[order], n[order]
        digests = table["digest"].take(pa.array(order)).to_pylist()
        found: dict[str, list] = {c: [] for c in ("tree", "level", "lo", "hi", "n", "digest")}

        def emit(level: int, keep: np.ndarray) -> None:
            width = FANOUT**level
            lo = place[keep] * width
            found["tree"].append(tree[keep])
            found["level"].append(np.full(len(keep), level, np.int32))
            found["lo"].append(lo)
            found["hi"].append(np.minimum(lo + width, n[keep]))
            found["n"].append(n[keep])
            found["digest"] += [digests[k] for k in keep.tolist()]

        if base == 0:
            emit(0, np.flatnonzero(n == 1))
        for level in range(base, base + BAND):
            still = np.flatnonzero(n > FANOUT**level)
            if not len(still):
                break
            tree, place, n, digests = tree[still], place[still] // FANOUT, n[still], [digests[k] for k in still.tolist()]
            first = _runs(tree, place)
            ends = [*first[1:].tolist(), len(tree)]
            digests = [hashlib.sha256("".join(digests[a:b]).encode()).hexdigest() for a, b in zip(first.tolist(), ends)]
            tree, place, n = tree[first], place[first], n[first]
            emit(level + 1, np.arange(len(tree)))
        columns = {k: (np.concatenate(v) if v else np.zeros(0, np.int32 if k == "level" else np.int64)) for k, v in found.items() if k != "digest"}
        return pa.table(columns | {"digest": pa.array(found["digest"], pa.string())})

    return run


def _attach(base: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Members with their whole paths, from the nodes of the band and the paths of the buckets' tops."""

    def run(members: pa.Table, above: pa.Table) -> pa.Table:
        members = members.take(pa.array(np.lexsort((members["place"].to_numpy(), members["tree"].to_numpy()))))
        is_node = np.asarray(above["level"].is_valid())
        nodes, tops = above.filter(pa.array(is_node)), above.filter(pa.array(~is_node))
        place, n = members["place"].to_numpy(), members["n"].to_numpy()
        trees, tree = np.unique(members["tree"].to_numpy(), return_inverse=True)
        span = int(n.max(initial=0)) + 1
        lo = place * FANOUT**base
        child = {"key": tree * span + lo, "tree": tree, "lo": lo, "digest": members["digest"].to_pylist()}
        levels = nodes["level"].to_numpy()
        before: list[str] = []
        after: list[str] = []
        chain = np.full((len(members), BAND), -1)
        at = np.arange(len(members))
        for level in range(base + 1, base + BAND + 1):
            part = nodes.filter(pa.array(levels == level))
            if not len(part):
                break
            owner, start, end = np.searchsorted(trees, part["tree"].to_numpy()), part["lo"].to_numpy(), part["hi"].to_numpy()
            order = np.lexsort((start, owner))
            owner, start, end = owner[order], start[order], end[order]
            parent = {"key": owner * span + start, "tree": owner, "lo": start, "digest": part["digest"].take(pa.array(order)).to_pylist()}
            # Containment: the last interval that begins at or before the child and ends behind its beginning.
            up = np.searchsorted(parent["key"], child["key"], side="right") - 1
            inside = (up >= 0) & (parent["tree"][up] == child["tree"]) & (child["lo"] < end[up])
            # Siblings: what the parent's interval holds besides the child's own.
            first, last = np.searchsorted(child["key"], parent["key"]), np.searchsorted(child["key"], owner * span + end)
            step = np.full(len(child["lo"]), -1)
            step[inside] = len(before) + np.arange(inside.sum())
            digest = child["digest"]
            for k in np.flatnonzero(inside).tolist():
                before.append("".join(digest[first[up[k]] : k]))
                after.append("".join(digest[k + 1 : last[up[k]]]))
            there = at >= 0
            chain[there, level - base - 1] = step[at[there]]
            at[there] = np.where(inside, up, -1)[at[there]]
            child = parent
        # The rest of the path is that of the bucket's top.
        key = np.searchsorted(trees, tops["tree"].to_numpy()) * span + tops["bucket"].to_numpy()
        order = np.argsort(key)
        top = order[np.searchsorted(key[order], tree * span + place // FANOUT**BAND)]
        paths = tops["path"].combine_chunks()
        size = paths.value_lengths().to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1] + len(before)
        given = paths.flatten()
        own = (chain >= 0).sum(axis=1)
        ends = np.cumsum(own + size[top])
        begins = ends - own - size[top]
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for k in range(BAND):
            has = own > k
            flat[begins[has] + k] = chain[has, k]
        for k in range(int(size.max(initial=0))):
            has = size[top] > k
            flat[begins[has] + own[has] + k] = begin[top[has]] + k
        steps = [pa.concat_arrays([pa.array(new, pa.string()), given.field(c)]).take(pa.array(flat)) for new, c in ((before, "before"), (after, "after"))]
        path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.StructArray.from_arrays(steps, ["before", "after"]))
        out = {c: members[c] for c in ("tree", "place", "doc_id", "digest", "other")}
        return pa.table(out | {"path": path, "subroot": tops["subroot"].take(pa.array(top))})

    return run


@dataclass
class Forest:
    """Members and nodes of every band, lowest first."""

    members: list[DataFrame]
    nodes: list[DataFrame]
    tasks: list[int]

    def all_nodes(self) -> DataFrame:
        """tree, level, lo, hi, n, digest of the nodes above the leaves (and of lone leaves)."""
        out = self.nodes[0]
        for more in self.nodes[1:]:
            out = out.unionByName(more)
        return out

    def roots(self) -> DataFrame:
        """tree, n and the digest of its top: the node that covers the whole tree."""
        return self.all_nodes().where("lo = 0 and hi = n").select("tree", "n", "digest")


def _task(bucket: Column, tasks: int) -> Column:
    return F.pmod(F.xxhash64("tree", bucket), F.lit(tasks))


def grow(leaves: DataFrame, rows: int, largest: int) -> Forest:
    """All nodes over ``leaves`` (tree, place from 0, n of the tree, digest, doc_id, other); ``rows`` of them, ``largest`` in one tree."""
    out = Forest([], [], [])
    members, band = leaves, 0
    while True:
        base = band * BAND
        tasks = int(max(1, -(-rows // FANOUT**base // TASK)))
        dealt = members.withColumn("task", _task(F.expr(f"place div {FANOUT**BAND}L"), tasks))
        out.members.append(dealt)
        out.tasks.append(tasks)
        out.nodes.append(cut(dealt.select("task", "tree", "place", "n", "digest").groupBy("task").applyInArrow(_grow(base), _NODE), "merkle-nodes"))
        band += 1
        width = FANOUT ** (band * BAND)
        if largest <= width:
            return out
        tops = out.nodes[-1].where((F.col("level") == band * BAND) & (F.col("n") > width))
        members = tops.selectExpr("tree", f"lo div {width}L as place", "n", "digest", "cast(null as long) as doc_id", "cast(null as string) as other")


def attach(forest: Forest, tops: DataFrame) -> DataFrame:
    """Leaves with path and subroot; ``tops`` has tree, n, subroot and the path above the tree."""
    found = None
    for band in reversed(range(len(forest.nodes))):
        base, tasks = band * BAND, forest.tasks[band]
        ends = F.col("n") <= FANOUT ** (base + BAND)
        if band:
            ends = ends & (F.col("n") > FANOUT**base)
        paths = tops.where(ends).selectExpr("tree", "0L as bucket", "path", "subroot")
        if found is not None:
            paths = paths.unionByName(found.selectExpr("tree", "place as bucket", "path", "subroot"))
        nodes = forest.nodes[band].where(F.col("level") > base).selectExpr("tree", "level", "lo", "hi", "digest", f"lo div {FANOUT ** (base + BAND)}L as bucket")
        above = nodes.unionByName(paths, allowMissingColumns=True).withColumn("task", _task(F.col("bucket"), tasks))
        above = above.select("task", "tree", "level", "lo", "hi", "digest", "bucket", F.col("path").cast(_PATH).alias("path"), "subroot")
        schema = f"tree long, place long, doc_id long, digest string, other string, path {_PATH}, subroot string"
        found = forest.members[band].groupBy("task").cogroup(above.groupBy("task")).applyInArrow(_attach(base), schema)
        if band:
            found = cut(found, "merkle-paths")
    return found


def prove(leaves: DataFrame) -> tuple[DataFrame, str | None]:
    """Paths of all ``leaves`` (group, doc_id, digest, other), and the root (None without rows).

    The result has doc_id, digest, other, subroot and path. The leaves of a
    group ascend by doc_id; groups ascend by their UTF-8 bytes, null first.
    """
    leaves = cut(leaves, "merkle-leaves")
    groups = cut(dense_numbers(leaves.groupBy("group").agg(F.count(F.lit(1)).alias("n")), ["group"], "tree"), "merkle-groups")
    many, rows, largest = groups.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    if not many:
        none = leaves.sparkSession.createDataFrame([], f"doc_id long, digest string, other string, subroot string, path {_PATH}")
        return none, None
    ranked = dense_numbers(leaves, ["doc_id", "digest", "other"], "rank", ["group"])
    # A group's row meets its leaves once in every CHUNK ranks, so a large group is many keys.
    chunks = groups.selectExpr("group as of", "tree", "n", f"explode(sequence(0L, (n - 1) div {CHUNK})) as chunk")
    placed = ranked.withColumn("place", F.col("rank") - 1).withColumn("part", F.expr(f"place div {CHUNK}"))
    joined = placed.join(chunks, F.col("group").eqNullSafe(F.col("of")) & (F.col("part") == F.col("chunk")))
    trees = grow(cut(joined.select("tree", "place", "n", "digest", "doc_id", "other"), "merkle-members"), rows, largest)
    subroots = cut(trees.roots(), "merkle-subroots")
    over = grow(subroots.selectExpr("0L as tree", "tree - 1 as place", f"{many}L as n", "digest", "cast(null as long) as doc_id", "cast(null as string) as other"), many, many)
    root = over.roots().first()["digest"]  # one digest
    start = subroots.sparkSession.createDataFrame([(0, many, root, [])], f"tree long, n long, subroot string, path {_PATH}")
    above = cut(attach(over, start), "merkle-above").selectExpr("place + 1 as tree", "digest as subroot", "path")
    found = attach(trees, subroots.select("tree", "n").join(above, "tree"))
    return found.select("doc_id", "digest", "other", "subroot", "path"), root


def tampered(docs: DataFrame) -> Column:
    """Digest of the row without its text's line feeds where 2 divides the CRC of its id, else null."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    values = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    return F.when(even, leaf_digest(values))


def manifest(docs: DataFrame) -> DataFrame:
    """The columns of query op11 for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", F.col("text").cast("string").alias("text"))
    leaves = rows.select(F.col("source").cast("string").alias("group"), "doc_id", leaf_digest([F.col(c) for c in FIELDS]).alias("digest"), tampered(rows).alias("other"))
    found, root = prove(leaves)
    folded = fold(F.coalesce("other", "digest"), F.col("path"))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
