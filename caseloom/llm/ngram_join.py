"""Similarity self-join of documents on word n-grams by vertical partitioning.

The global order of n-grams goes from rare to frequent, by document frequencies
counted over all documents; n-grams of one document count for its size only.
The order is cut into fragments, the same for all documents: a document's set
becomes one segment a fragment. For pairs that may link, each fragment counts
its partial overlap on its own, and the partial counts are summed per pair.

Pairs that may link meet where the first n-grams of their ordered sets (as many
as the threshold requires) coincide. Documents of equal words are one
representative. Among the documents that meet at an n-gram, all are first
paired with one of them, the anchor (a document takes the first anchor of its
n-grams, in an order by hash), and linked documents become one class; only
classes that still meet are paired again. So a group of near copies costs a
pair a document and not a pair of each two. What still meets then is worked off
in pairs of blocks of documents: each fragment counts a block pair's partial
overlaps as one packed matrix, and the matrices are summed; a block pair returns
a spanning forest of its links. Blocks of one class are not paired. No link
between classes is lost, whatever the groups.

Links found on hashes are verified on the words of the texts.

Null and empty texts have empty sets and link with nothing; equal sets of
different rows always link. Repeated ids are one document in the result's
components and a row each in the result. A row with a null id keeps its count,
has a null component and links with nothing. Other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .components import components
from .scratch import cut, discard
from .words import shingles, split_words

#: Where the global order is cut: at the first n-gram of these frequency classes, and half-way through the first class.
CUTS = (2, 3, 5, 17, 65)
#: Rows that meet one anchor in a task's group, and bytes of a task's groups, on average.
ANCHOR_ROWS, CELL_BYTES = 2048, 4 << 20
#: Rounds of anchors before blocks are paired; a second one where more than so many pairs an n-gram are left.
ROUNDS, PAIRS_PER_ENTRY = 2, 16
#: Documents of a block, and columns of n-grams that are multiplied at once.
SIDE_DOCS, COLUMNS = 1024, 4096


def linked(overlap, a, b, percent: int):
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * overlap >= percent * (a + b - overlap)


def document_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_grams; and, where a link is possible, words_key, prefix (n-gram, place in the order), segments, body (the text, compressed)."""

    def extract(words):
        return (*shingles(words, n), None)

    def finish(doc_ids, texts, keys, classes):
        count = np.bincount(keys.doc, minlength=len(doc_ids))
        shared = np.bincount(keys.doc, weights=classes >= 2, minlength=len(doc_ids))
        alive = (count > 0) & (100 * shared >= percent * count)
        part = alive[keys.doc]
        key, doc, cls = keys.key[part], keys.doc[part], classes[part]
        order = np.lexsort((key, cls, doc))
        key, doc, cls = key[order], doc[order], cls[order]
        fragment = 2 * np.searchsorted(CUTS, cls, side="right") + ((cls == CUTS[0]) & (key >= np.uint64(1 << 63)))
        cuts = np.searchsorted(doc, np.arange(len(doc_ids) + 1))
        words_key, prefix, segments, body = [], [], [], []
        for k in range(len(doc_ids)):
            if not alive[k] or doc_ids[k] is None:
                words_key.append(None), prefix.append(None), segments.append(None), body.append(None)
                continue
            a, b = cuts[k], cuts[k + 1]
            own, c, f = key[a:b], cls[a:b], fragment[a:b]
            first = len(own) - -(-percent * len(own) // 100) + 1
            body.append(zlib.compress(texts[k], 1))
            words_key.append(hashlib.blake2b(b" ".join(texts[k].lower().split()), digest_size=16).digest())
            at = np.flatnonzero(c[:first] >= 2)
            prefix.append([{"gram": g, "place": i} for g, i in zip(own[at].view(np.int64).tolist(), at.tolist())])
            lo = int(np.searchsorted(c, 2))
            edges = [lo, *(lo + 1 + np.flatnonzero(f[lo + 1 :] != f[lo:-1])).tolist(), b - a] if lo < b - a else []
            segments.append([{"fragment": int(f[x]), "grams": own[x:y].tobytes()} for x, y in zip(edges[:-1], edges[1:])])
        return pa.table([doc_ids, count, words_key, prefix, segments, body], schema=_SETS)

    return blocks.with_frequencies(docs, blocks.plan(docs, 0.2), extract, finish, _SETS_SQL, _SETS)


_SETS_SQL = "doc_id long, n_grams long, words_key binary, prefix array<struct<gram:long,place:int>>, segments array<struct<fragment:int,grams:binary>>, body binary"
_SETS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_grams", pa.int64()),
        ("words_key", pa.binary()),
        ("prefix", pa.list_(pa.struct([("gram", pa.int64()), ("place", pa.int32())]))),
        ("segments", pa.list_(pa.struct([("fragment", pa.int32()), ("grams", pa.binary())]))),
        ("body", pa.binary()),
    ]
)


def may_link(x: str, y: str, percent: int) -> Column:
    """By sizes, and by what can still follow the first common n-gram in either order."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.place"), F.col(f"{y}.place")
    sizes = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
    rest = F.least(nx - px, ny - py)
    return sizes & (rest * (100 + percent) >= (nx + ny) * percent)


def anchored(cells: DataFrame, blob: str, count, size: int) -> DataFrame:
    """Run ``count(ids of x, blobs of x, blob of the anchor)`` for the rows (a, x, fragment, blob) that meet an anchor.

    ``cells``: rows (a, x or null for the anchor itself, fragment, side, blob), ``size``: about their bytes. Returns (x, a, part), zeros left out.
    Rows of one anchor are on as many sides as bound them; sides of many anchors share a task's group.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("fragment", "ascending"), ("a", "ascending"), ("side", "ascending"), ("x", "ascending")])
        a, side, fragment = (table[c].to_numpy() for c in ("a", "side", "fragment"))
        cuts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (side[1:] != side[:-1]) | (fragment[1:] != fragment[:-1]), [True]]))
        x, blobs = table["x"].to_pylist(), table[blob].to_pylist()
        out: list[list] = [[], [], []]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = [k for k in range(lo, hi) if x[k] is None]  # nulls sort last
            rows = range(lo, hi - len(own))
            if own and rows:
                got = count([blobs[k] for k in rows], [blobs[k] for k in own])
                for k, v in zip(rows, got):
                    if v:
                        out[0].append(x[k]), out[1].append(int(a[lo])), out[2].append(int(v))
        return pa.table({"x": pa.array(out[0], pa.int64()), "a": pa.array(out[1], pa.int64()), "part": pa.array(out[2], pa.int64())})

    cell = F.pmod(F.xxhash64("a", "side", "fragment"), F.lit(max(8, size // CELL_BYTES)))
    return cells.withColumn("cell", cell).groupBy("cell").applyInArrow(run, "x long, a long, part long")


def with_anchors(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, x, side, columns of ``rows``) for both ends of pairs (x, a); the anchor's own row (x null) once a side. ``rows`` has ``row``."""
    sides = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(ANCHOR_ROWS)).cast("int").alias("sides")), "anchors")
    met = pairs.join(sides, "a").select("a", "x", F.pmod(F.xxhash64(F.lit(3), "x"), F.col("sides")).cast("int").alias("side"), F.col("x").alias("row"))
    own = sides.select("a", F.lit(None).cast("long").alias("x"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), F.col("a").alias("row"))
    return met.unionByName(own).join(rows, "row").drop("row")


def count_overlaps(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(x, a, overlap) of pairs (x, a): partial counts of every fragment, summed per pair."""

    def count(blobs: list[bytes], own: list[bytes]) -> np.ndarray:
        anchor = np.sort(np.frombuffer(own[0], np.uint64))
        grams = np.frombuffer(b"".join(blobs), np.uint64)
        found = anchor[np.minimum(np.searchsorted(anchor, grams), len(anchor) - 1)] == grams
        return np.bincount(np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs]), weights=found, minlength=len(blobs))

    segments = with_anchors(pairs, reps.select("row", "segments")).select("a", "x", "side", F.explode("segments").alias("s"))
    cells = segments.select("a", "x", "side", F.col("s.fragment").alias("fragment"), F.col("s.grams").alias("grams"))
    size = reps.agg(F.sum("n_grams")).first()[0] or 0
    partial = anchored(cells, "grams", count, 8 * size)
    return partial.groupBy("x", "a").agg(F.sum("part").alias("overlap"))


def verified(links: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """Those links (x, a) that hold on the words of the texts."""

    def grams(body: bytes) -> set[tuple[bytes, ...]]:
        found = split_words([zlib.decompress(body)])
        low = found.raw.tobytes()
        words = [low[s:e] for s, e in zip(found.start.tolist(), found.end.tolist())]
        return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)} - {()}

    def count(bodies: list[bytes], own: list[bytes]) -> list[int]:
        anchor = grams(own[0])
        return [int(linked(len(mine & anchor), len(mine), len(anchor), percent)) for mine in map(grams, bodies)]

    cells = with_anchors(links, reps.select("row", "body")).withColumn("fragment", F.lit(0))
    size = reps.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return anchored(cells, "body", count, 3 * size).select("x", "a")


def _with_anchor(entries: DataFrame, seed: int) -> DataFrame:
    """Entries x with the anchor y of their n-gram, where that is of another class."""
    anchor = F.min(F.struct(F.xxhash64(F.lit(seed), "row").alias("h"), "row", "n", "place", "class")).alias("y")
    anchors = entries.groupBy("gram").agg(anchor, F.count(F.lit(1)).alias("m")).where("m > 1").select("gram", "y")
    return entries.alias("x").join(anchors, "gram").where("x.class <> y.class")


def near_links(alive: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (x, a) between rows that connect all rows that link. ``alive``: row, n_grams, prefix, segments, body."""
    first = alive.select("row", F.col("n_grams").alias("n"), F.explode("prefix").alias("p"))
    entries = cut(first.select(F.col("p.gram").alias("gram"), "row", "n", F.col("p.place").alias("place"), F.col("row").alias("class")), "entries")
    reps = links = None
    for turn in range(ROUNDS + 1):
        per_gram = entries.groupBy("gram", "class").agg(F.count(F.lit(1)).alias("m")).groupBy("gram").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
        mixed = cut(per_gram.where("m * m > own").select("gram", "m", ((F.col("m") * F.col("m") - F.col("own")) / 2).alias("pairs")), "mixed")
        size = mixed.agg(F.sum("pairs"), F.sum("m")).first()
        if not size[0]:
            break
        entries = _replaced(entries, entries.join(mixed.select("gram"), "gram").select(*entries.columns), "entries")
        discard(mixed)
        if reps is None:  # rows that meet no other leave here
            reps = cut(alive.join(entries.select("row").distinct(), "row", "left_semi").select("row", "n_grams", "segments", "body"), "reps")
        if turn == ROUNDS or (turn and size[0] <= PAIRS_PER_ENTRY * size[1]):
            links = links.unionByName(cut(verified(block_links(entries, reps, percent), reps, n, percent), "near"))
            break
        met = _with_anchor(entries, turn).where(may_link("x", "y", percent)).groupBy(F.col("x.row").alias("x"))
        pairs = met.agg(F.min(F.struct("y.h", "y.row")).alias("y")).select("x", F.col("y.row").alias("a"))
        pairs = cut(pairs, "pairs")
        sizes = reps.select(F.col("row"), F.col("n_grams").alias("n"))
        counted = count_overlaps(pairs, reps).join(sizes.toDF("x", "nx"), "x").join(sizes.toDF("a", "na"), "a")
        near = counted.where(linked(F.col("overlap"), F.col("nx"), F.col("na"), percent)).select("x", "a")
        found = cut(verified(cut(near, "links"), reps, n, percent), "near")
        links = found if links is None else links.unionByName(found)
        discard(pairs)
        classes = components(links.toDF("a", "b")).toDF("row", "component")
        entries = _replaced(entries, entries.join(classes, "row", "left").select("gram", "row", "n", "place", F.coalesce("component", "row").alias("class")), "entries")
    for table in (entries, reps):
        discard(table)
    return links if links is not None else alive.select(F.col("row").alias("x"), F.col("row").alias("a")).where("false")


def _replaced(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    new = cut(new, name)
    discard(old)
    return new


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap of every left set with every right set."""
    grams = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[column] >= 2
    number = np.cumsum(times >= 2) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(left), len(right)), dtype=np.int32)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(left) + len(right), min(COLUMNS, width - lo)), dtype=np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += (part[: len(left)] @ part[len(left) :].T).astype(np.int32)
    return total


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all ``links`` connect; no more of them than documents."""
    out: list[tuple[int, int]] = []
    todo_left, todo_right = links.any(axis=1), links.any(axis=0)
    while todo_left.any():
        front = [int(todo_left.argmax())]
        todo_left[front] = False
        while front:
            k = front.pop()
            for r in np.flatnonzero(links[k] & todo_right).tolist():
                todo_right[r] = False
                more = np.flatnonzero(links[:, r] & todo_left)
                todo_left[more] = False
                out.append((int(left[k]), int(right[r])))
                out += [(int(x), int(right[r])) for x in left[more]]
                front += more.tolist()
    return [(a, b) for a, b in out if a != b]


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of rows in a row that agree in all columns."""
    change = np.zeros(len(columns[0]) + 1, bool)
    change[[0, -1]] = True
    for c in columns:
        change[1:-1] |= c[1:] != c[:-1]
    cuts = np.flatnonzero(change).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def block_pairs(entries: DataFrame) -> DataFrame:
    """(i, j, side, row, class): rows of the blocks i (side 0) and j (side 1) of each pair of blocks in which classes still meet."""
    least = entries.groupBy("gram").agg(F.min("row").alias("b"))
    meetings = entries.join(least, "gram").where("row <> b").select(F.col("row").alias("a"), "b")
    groups = components(meetings).toDF("row", "grp")
    members = cut(entries.select("row", "class").distinct().join(groups, "row"), "members")
    classes = members.groupBy("grp", "class").agg(F.count(F.lit(1)).alias("c"))
    large = F.col("c") > SIDE_DOCS // 2
    sides = classes.groupBy("grp").agg(F.ceil(F.sum(F.when(large, 0).otherwise(F.col("c"))) / SIDE_DOCS).alias("sides"), F.count(F.lit(1)).alias("k")).where("k > 1")
    classes = cut(classes.join(sides, "grp"), "classes")
    own = F.pmod(F.xxhash64(F.lit(3), "row"), F.ceil(F.col("c") / SIDE_DOCS))
    block = F.when(large, F.xxhash64(F.lit(1), "grp", "class", own)).otherwise(F.xxhash64(F.lit(2), "grp", F.pmod(F.xxhash64("class"), F.greatest("sides", F.lit(1)))))
    members = cut(members.join(classes, ["grp", "class"]).select("grp", "row", "class", block.alias("block"), F.when(large, F.col("class")).alias("only")), "blocks")
    blocks_ = members.groupBy("grp", "block").agg(F.max("only").alias("only"))
    one, two = (blocks_.toDF("grp", side, f"only_{side}") for side in ("i", "j"))
    apart = F.col("only_i").isNull() | F.col("only_j").isNull() | (F.col("only_i") != F.col("only_j"))
    pairs = cut(one.join(two, "grp").where((F.col("i") <= F.col("j")) & apart).select("grp", "i", "j"), "block-pairs")
    rows = members.select("grp", "block", "row", "class")
    first = rows.join(pairs.withColumn("block", F.col("i")), ["grp", "block"]).select("i", "j", F.lit(0).alias("side"), "row", "class")
    second = rows.join(pairs.where("i <> j").withColumn("block", F.col("j")), ["grp", "block"]).select("i", "j", F.lit(1).alias("side"), "row", "class")
    return first.unionByName(second)


def block_links(entries: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (x, a) that connect all links between classes that still meet."""
    about = np.dtype([("row", "<i8"), ("n", "<i8"), ("class", "<i8")])

    def count(table: pa.Table) -> pa.Table:
        """One fragment's partial overlaps of block pairs."""
        table = table.sort_by([(c, "ascending") for c in ("i", "j", "fragment", "side", "row")])
        i, j, fragment, side = (table[c].to_numpy() for c in ("i", "j", "fragment", "side"))
        rows = np.empty(table.num_rows, about)
        for name, column in (("row", "row"), ("n", "n_grams"), ("class", "class")):
            rows[name] = table[column].to_numpy()
        grams = [np.frombuffer(b, np.uint64) for b in table["grams"].to_pylist()]
        out: list[list] = [[], [], [], [], []]
        for lo, hi in _runs(i, j, fragment):
            half = hi if i[lo] == j[lo] else lo + int(np.searchsorted(side[lo:hi], 1))
            left, right = (lo, half), ((lo, half) if i[lo] == j[lo] else (half, hi))
            if left[0] < left[1] and right[0] < right[1]:
                got = _overlaps(grams[slice(*left)], grams[slice(*right)])
                for column, value in zip(out, (int(i[lo]), int(j[lo]), rows[slice(*left)].tobytes(), rows[slice(*right)].tobytes(), zlib.compress(got.astype("<i4").tobytes(), 1))):
                    column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["i", "j", "left", "right", "counts"])

    def total(table: pa.Table) -> pa.Table:
        """Sums of the fragments' matrices, and the links."""
        out: list[tuple[int, int]] = []
        lefts, rights = ([np.frombuffer(b, about) for b in table[c].to_pylist()] for c in ("left", "right"))
        left, right = np.unique(np.concatenate(lefts)), np.unique(np.concatenate(rights))
        summed = np.zeros((len(left), len(right)), np.int64)
        for x, y, blob in zip(lefts, rights, table["counts"].to_pylist()):
            part = np.frombuffer(zlib.decompress(blob), "<i4").reshape(len(x), len(y))
            summed[np.searchsorted(left["row"], x["row"])[:, None], np.searchsorted(right["row"], y["row"])[None, :]] += part
        ok = linked(summed, left["n"][:, None], right["n"][None, :], percent) & (left["class"][:, None] != right["class"][None, :])
        out += _forest(ok, left["row"], right["row"])
        return pa.table({"x": pa.array([x for x, _ in out], pa.int64()), "a": pa.array([a for _, a in out], pa.int64())})

    rows = cut(block_pairs(entries), "block-rows")
    size = rows.join(reps.select("row", "n_grams"), "row").agg(F.sum("n_grams")).first()[0] or 0
    cell = F.pmod(F.xxhash64("i", "j", "fragment"), F.lit(max(8, 8 * size // CELL_BYTES))).alias("cell")
    segments = rows.join(reps.select("row", "n_grams", F.explode("segments").alias("s")), "row")
    cells = segments.select("i", "j", "side", "row", "class", "n_grams", F.col("s.fragment").alias("fragment"), F.col("s.grams").alias("grams")).withColumn("cell", cell)
    partial = cells.groupBy("cell").applyInArrow(count, "i long, j long, left binary, right binary, counts binary")
    return cut(partial.groupBy("i", "j").applyInArrow(total, "x long, a long"), "block-links")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    sets = cut(document_sets(docs, n, percent).withColumn("row", F.monotonically_increasing_id()), "sets")
    alive = sets.where("words_key is not null")
    classes = alive.groupBy("words_key").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1")
    # Written out, so that the join below can be split where one text has very many copies.
    classes = cut(classes.select("words_key", "rep"), "classes")
    same = cut(alive.select("doc_id", "row", "words_key").join(classes, "words_key").where("row <> rep.row").select("row", F.col("doc_id").alias("a"), F.col("rep.doc_id").alias("b")), "same")
    near = near_links(alive.join(same.select("row"), "row", "left_anti"), n, percent)
    ids = alive.select("row", "doc_id")
    near = near.join(ids.toDF("x", "b"), "x").join(ids.toDF("a", "c"), "a").select(F.col("b").alias("a"), F.col("c").alias("b"))
    found = components(near.unionByName(same.select("a", "b"))).withColumnRenamed("node", "doc_id")
    return sets.select("doc_id", F.col("n_grams").alias("n_shingles")).join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
