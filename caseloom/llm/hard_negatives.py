"""Hard-negative mining over candidate blocks in Hilbert order.

Candidates are sorted by label and place on a Hilbert curve through the cells of
all dimensions, and written as blocks of consecutive rows. A zone map keeps each
block's smallest and largest component in every dimension. For an anchor,
interval arithmetic over a zone gives the least and the greatest inner product
that any row of the block can have, and so says which blocks its windows must
read:

* positives: blocks of the anchor's label whose greatest product reaches the
  score of the weakest positive found in the blocks around the anchors;
* negatives: blocks that hold other labels and whose products meet one of the
  anchor's windows, and reach the least product of a block that lies inside the
  window and has enough rows to fill it.

Bounds are exact, so nothing is lost however little they rule out (in many
dimensions of independent values that is little). Anchors are in slices of the
same order, which read their blocks together, a part of at most PART blocks a
task; the best of each part are merged. Neither labels nor equal vectors gather
in one task: blocks are cut by number of rows.

Rows take part where label and vector are not null, and no component is null or
not finite. Components become floor(256 * x), held within 2 ** 24, so that
products of up to 1024 dimensions fit in a long. Only vectors of one length are
compared; empty vectors score 0. Repeated rows are rows of their own, an
anchor's copies too. Ties go to the smaller id, then to either row of that id.
Null ids can be candidates but not anchors; they come last among ties and their
ids are null. An empty table, or one without anchors, gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import dense_numbers
from .scratch import cut
from .vectors import matrix, sample

#: Rows of a candidate block, blocks that a task reads at once, anchors that read together, zones that are bounded together.
BLOCK, PART, SLICE, CHUNK = 512, 32, 512, 512
#: Bits of a dimension's cell on the curve.
BITS = 3
#: Largest size of a component after scaling.
LARGEST = 1 << 24

_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places of ``cells`` (rows x dimensions, below 2 ** bits) on the Hilbert curve, as bytes that sort like the numbers.

    Skilling's transform: undo the rotations of every bit, Gray-code, and weave
    the bits of all dimensions.
    """
    x = [c.astype(np.int64) for c in cells.T]
    if not x:
        return [b""] * len(cells)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for k in range(len(x)):
            set_ = (x[k] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
        bit >>= 1
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    woven = np.stack([((c ^ turn) >> b) & 1 for b in reversed(range(bits)) for c in x], axis=1).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(woven, axis=1)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in floating point where every sum stays below 2 ** 53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each row of ``a`` with any vector between ``lo`` and ``hi``."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def _by_dim(table: pa.Table) -> dict[int, pa.Table]:
    d = table["d"].to_numpy()
    return {int(k): table.filter(pa.array(d == k)) for k in np.unique(d)}


def _matrix(table: pa.Table, name: str, d: int) -> np.ndarray:
    return matrix(table[name], np.int64) if d else np.zeros((len(table), 0), np.int64)


def _keys(rows: DataFrame, edges: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with their place on the curve; vectors of lengths that the sample lacks have an empty one."""
    sent = rows.sparkSession.sparkContext.broadcast(edges)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.full(batch.num_rows, b"", dtype=object)
            d = table["d"].to_numpy()
            for dim in np.unique(d).tolist():
                if dim in sent.value:
                    at = np.flatnonzero(d == dim)
                    x = _matrix(table.take(pa.array(at)), "q", dim)
                    cells = np.stack([np.searchsorted(sent.value[dim][k], x[:, k], side="right") for k in range(dim)], axis=1)
                    keys[at] = hilbert_keys(cells, BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.binary())], names=[*batch.schema.names, "key"])

    return rows.mapInArrow(run, "row long, vec_id long, label long, q array<int>, d int, key binary")


def candidate_blocks(embeddings: DataFrame, label: Column | None = None, id_col="vec_id", vec_col="embedding", label_col="label") -> DataFrame:
    """Rows that take part as a table of blocks: block, number, row, vec_id, label, d, q."""
    v = F.col(vec_col).cast("array<double>")
    q = F.transform("v", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(256.0) * F.greatest(F.lit(-1e9), F.least(F.lit(1e9), x))))).cast("int"))
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("label").isNotNull() & ok)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), q.alias("q"), F.size("v").alias("d"))
    rows = cut(rows.where("label is not null"), "negatives-rows")
    cuts = np.arange(1, 1 << BITS) / (1 << BITS)
    edges = {m.shape[1]: np.quantile(m, cuts, axis=0).T for m in sample(rows, "row", "q") if m.shape[1]}
    numbered = dense_numbers(_keys(rows, edges), ["d", "label", "key", "row"], "number")
    blocks = numbered.select(F.expr(f"(number - 1) div {BLOCK}").alias("block"), "number", "row", "vec_id", "label", "d", "q")
    return cut(blocks, "negatives-blocks")


def zone_maps(blocks: DataFrame) -> DataFrame:
    """block, d, n, smallest and largest label and component; a block that lies in two files has two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {c: [] for c in ("block", "d", "n", "label_lo", "label_hi", "lo", "hi")}
            for d, table in _by_dim(pa.Table.from_batches([batch])).items():
                block, label, x = table["block"].to_numpy(), table["label"].to_numpy(), _matrix(table, "q", d)
                for b in np.unique(block).tolist():
                    at = block == b
                    row = (b, d, int(at.sum()), int(label[at].min()), int(label[at].max()), x[at].min(axis=0).tolist(), x[at].max(axis=0).tolist())
                    for c, value in zip(found, row):
                        found[c].append(value)
            ints = pa.list_(pa.int32())
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), ints, ints]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), types)], names=list(found))

    return cut(blocks.select("block", "label", "d", "q").mapInArrow(run, "block long, d int, n long, label_lo long, label_hi long, lo array<int>, hi array<int>"), "negatives-zones")


def _choose_positives(anchors: pa.Table, zones: pa.Table, k: int) -> np.ndarray:
    """Blocks that a slice's anchors must read for their best of the same label."""
    chosen = []
    mine = _by_dim(anchors)
    for d, zone in _by_dim(zones).items():
        if d in mine:
            part = mine[d]
            label, least = part["label"].to_numpy(), part["least"].to_numpy()
            _, most = bounds(_matrix(part, "q", d), _matrix(zone, "lo", d), _matrix(zone, "hi", d))
            holds = (zone["label_lo"].to_numpy()[None, :] <= label[:, None]) & (label[:, None] <= zone["label_hi"].to_numpy()[None, :])
            chosen.append(zone["block"].to_numpy()[(holds & (most >= least[:, None])).any(axis=0)])
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def _choose_negatives(anchors: pa.Table, zones: pa.Table, k: int) -> np.ndarray:
    """Blocks that a slice's windows must read for their best of other labels."""
    chosen = []
    mine = _by_dim(anchors)
    for d, zone in _by_dim(zones).items():
        if d in mine:
            part = mine[d]
            label = part["label"].to_numpy()
            least, most = bounds(_matrix(part, "q", d), _matrix(zone, "lo", d), _matrix(zone, "hi", d))
            lo, hi = zone["label_lo"].to_numpy(), zone["label_hi"].to_numpy()
            wanted = np.zeros(len(zone), bool)
            for k_anchor, windows in enumerate(part["windows"].to_pylist()):
                own = label[k_anchor]
                other, without = ~((lo == own) & (hi == own)), (own < lo) | (own > hi)
                full = without & (zone["n"].to_numpy() >= k)
                for w in windows:
                    meets = other & (most[k_anchor] >= w["lo"]) & (least[k_anchor] <= w["hi"])
                    within = full & (least[k_anchor] >= w["lo"]) & (most[k_anchor] <= w["hi"])
                    if within.any():
                        meets &= most[k_anchor] >= least[k_anchor][within].max()
                    wanted |= meets
            chosen.append(zone["block"].to_numpy()[wanted])
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def _best(score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by id and row."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
    return at[np.lexsort((row[at], vec_id[at], -score[at]))][:k]


def _read_positives(anchors: pa.Table, rows: pa.Table, k: int) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in ("anchor", "positive", "row", "vec_id", "score")}
    mine = _by_dim(anchors)
    for d, part in _by_dim(rows).items():
        if d not in mine:
            continue
        ask = mine[d]
        row, vec_id, label = part["row"].to_numpy(), _ids(part), part["label"].to_numpy()
        x = _matrix(part, "q", d)
        own_label, own_row, a = ask["label"].to_numpy(), ask["row"].to_numpy(), _matrix(ask, "q", d)
        for value in np.unique(own_label).tolist():
            same, who = np.flatnonzero(label == value), np.flatnonzero(own_label == value)
            score = products(a[who], x[same])
            for k_anchor, s in zip(who.tolist(), score):
                other = row[same] != own_row[k_anchor]
                at, s = same[other], s[other]
                best = _best(s, vec_id[at], row[at], k)
                out["anchor"] += [int(own_row[k_anchor])] * len(best)
                out["positive"] += [None] * len(best)
                out["row"] += row[at[best]].tolist()
                out["vec_id"] += vec_id[at[best]].tolist()
                out["score"] += s[best].tolist()
    return out


def _read_negatives(anchors: pa.Table, rows: pa.Table, k: int) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in ("anchor", "positive", "row", "vec_id", "score")}
    mine = _by_dim(anchors)
    for d, part in _by_dim(rows).items():
        if d not in mine:
            continue
        ask = mine[d]
        row, vec_id, label = part["row"].to_numpy(), _ids(part), part["label"].to_numpy()
        own_label, own_row = ask["label"].to_numpy(), ask["row"].to_numpy()
        score = products(_matrix(ask, "q", d), _matrix(part, "q", d))
        for k_anchor, windows in enumerate(ask["windows"].to_pylist()):
            differs = label != own_label[k_anchor]
            # The windows of an anchor overlap: what none of them can take goes first.
            s = score[k_anchor]
            near = np.flatnonzero(differs & (s >= min(w["lo"] for w in windows)) & (s <= max(w["hi"] for w in windows)))
            for w in windows:
                at = near[(s[near] >= w["lo"]) & (s[near] <= w["hi"])]
                best = at[_best(s[at], vec_id[at], row[at], k)]
                out["anchor"] += [int(own_row[k_anchor])] * len(best)
                out["positive"] += [w["positive"]] * len(best)
                out["row"] += row[best].tolist()
                out["vec_id"] += vec_id[best].tolist()
                out["score"] += s[best].tolist()
    return out


#: Stands for a null id inside tasks, so that it comes last among ties.
_NO_ID = np.iinfo(np.int64).max


def _ids(table: pa.Table) -> np.ndarray:
    return table["vec_id"].fill_null(int(_NO_ID)).to_numpy()


_FOUND = "anchor long, positive long, row long, vec_id long, score long"
_TYPES = [pa.int64()] * 5


def _task(*keys: str) -> Column:
    return F.xxhash64(*keys)


def choose(anchors: DataFrame, zones: DataFrame, chunks: int, slices: int, kernel: Callable, k: int) -> DataFrame:
    """slice and block: what each slice of ``anchors`` must read, by the bounds of ``zones``; chunk by chunk."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    asks = anchors.withColumn("chunk", every(chunks)).withColumn("task", _task("slice", "chunk"))
    told = zones.withColumn("chunk", F.expr(f"block div {CHUNK}")).withColumn("slice", every(slices)).withColumn("task", _task("slice", "chunk"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = kernel(left, right, k) if len(left) and len(right) else np.zeros(0, np.int64)
        name = left["slice"][0].as_py() if len(left) else 0
        return pa.table({"slice": pa.array([name] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.int64())})

    return cut(asks.groupBy("task").cogroup(told.groupBy("task")).applyInArrow(run, "slice long, block long"), "negatives-chosen")


def read(anchors: DataFrame, blocks: DataFrame, chosen: DataFrame, kernel: Callable, k: int) -> DataFrame:
    """Best rows of the chosen blocks for every anchor, a part of the blocks at a time: ``k`` of each part."""
    part = F.expr(f"block div {PART}")
    parts = chosen.select("slice", part.alias("part")).distinct()
    asks = anchors.join(parts, "slice").withColumn("task", _task("slice", "part"))
    rows = blocks.select("block", "row", "vec_id", "label", "d", "q").join(chosen, "block").withColumn("part", part).withColumn("task", _task("slice", "part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = kernel(left, right, k) if len(left) and len(right) else {c: [] for c in ("anchor", "positive", "row", "vec_id", "score")}
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(found.items(), _TYPES)})

    return cut(asks.groupBy("task").cogroup(rows.groupBy("task")).applyInArrow(run, _FOUND), "negatives-found")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of ``found`` for each of ``keys``; parts have left at most ``k`` each."""
    line = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), id_col="vec_id", vec_col="embedding", label_col="label"
) -> DataFrame:
    """For each anchor and each of its nearest ``positives`` of the same label, the first ``negatives`` of other labels in the window.

    ``is_anchor`` is a condition on vec_id; ``label`` replaces the label column.
    The window is in percent of the positive's score, ends included.
    """
    spark = embeddings.sparkSession
    blocks = candidate_blocks(embeddings, label, id_col, vec_col, label_col)
    asking = cut(dense_numbers(blocks.where(is_anchor), ["number"], "place"), "negatives-anchors")
    n_anchors, last = asking.count(), blocks.agg(F.max("block")).first()[0]
    if not n_anchors:
        return spark.createDataFrame([], _OUT)
    slices, chunks = -(-n_anchors // SLICE), last // CHUNK + 1
    anchors = asking.select(F.expr(f"(place - 1) div {SLICE}").alias("slice"), "block", "row", "vec_id", "label", "d", "q")
    zones = zone_maps(blocks)
    # The blocks around the anchors give each a score that its positives reach.
    ask = anchors.drop("block", "vec_id")
    own = cut(anchors.select("slice", "block").distinct(), "negatives-own")
    around = read(ask, blocks, own, _read_positives, positives)
    least = _first(around, ["anchor"], positives).where(F.col("rank") == positives).select(F.col("anchor").alias("row"), F.col("score").alias("least"))
    ask_least = cut(ask.join(least, "row", "left").withColumn("least", F.coalesce("least", F.lit(-(2**62)))), "negatives-least")
    wanted = choose(ask_least, zones, chunks, slices, _choose_positives, positives)
    best = cut(_first(read(ask, blocks, wanted, _read_positives, positives), ["anchor"], positives), "negatives-positives")
    low, high = window
    spans = best.select(
        "anchor",
        F.struct(
            F.col("row").alias("positive"),
            F.expr(f"({low} * score + pmod(-{low} * score, 100)) div 100").alias("lo"),
            F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("hi"),
        ).alias("w"),
    ).where("w.lo <= w.hi")
    windows = spans.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list("w")).alias("windows"))
    ask_windows = cut(ask.join(windows, "row"), "negatives-windows")
    wanted = choose(ask_windows, zones, chunks, slices, _choose_negatives, negatives)
    found = _first(read(ask_windows, blocks, wanted, _read_negatives, negatives), ["anchor", "positive"], negatives)
    no_id = F.lit(int(_NO_ID))
    pairs = best.select("anchor", F.col("row").alias("positive"), F.nullif("vec_id", no_id).alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.select("anchor", "positive", "rank", F.nullif("vec_id", no_id).alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "positive"])
    return named.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def query(embeddings: DataFrame) -> DataFrame:
    """The rows of query op12: every seventh label is one further, every fiftieth row is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings, F.col("vec_id") % 50 == 0, label)


OP12 = """WITH row_v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, len(embedding) AS d,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  score_v AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS s
    FROM row_v a JOIN row_v b ON a.d = b.d AND a.rid <> b.rid WHERE a.vec_id % 50 = 0),
  pos_v AS (SELECT arid, anchor_id, rid AS prid, vec_id AS positive_id, s AS positive_score FROM score_v WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY s DESC, vec_id, rid) <= 5),
  neg_v AS (SELECT p.*, n.vec_id AS negative_id, n.s AS negative_score, row_number() OVER (PARTITION BY arid, prid ORDER BY n.s DESC, n.vec_id, n.rid) AS rank
    FROM pos_v p JOIN score_v n USING (arid) WHERE NOT n.same AND 50 * positive_score <= 100 * n.s AND 100 * n.s <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg_v WHERE rank <= 3"""
