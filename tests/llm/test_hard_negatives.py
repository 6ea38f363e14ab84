"""Hard negatives against plain loops; places on the curve; bounds of zones."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row int, block string"


def expected(rows):
    part = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        part.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label, k))
    out = []
    for i, q, label, k in part:
        if i is None or i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p)), j if j is not None else 1 << 63, m, l, j) for j, p, l, m in part if m != k and len(p) == len(q)]
        for s, _, _, _, pid in sorted(x for x in scored if x[3] == label)[:5]:
            near = sorted(x for x in scored if x[3] != label and -50 * s <= -100 * x[0] <= -95 * s)
            out += [(i, pid, r + 1, x[4], -s, -x[0]) for r, x in enumerate(near[:3])]
    return out


def clean(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


def test_against_loops(spark, monkeypatch):
    for name, size in (("BLOCK", 16), ("PART", 2), ("SLICE", 2), ("CHUNK", 3)):
        monkeypatch.setattr(hn, name, size)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 8)) / 2
    rows = [(k, (centres[k % 6] + 0.2 * rng.standard_normal(8)).tolist(), int(k % 6)) for k in range(400)]
    rows[150] = (150, [0.0] * 8, 3)
    rows += [(1000 + k, rows[50][1], k % 3) for k in range(40)]  # equal vectors: ties
    rows += [(50, rows[50][1], 2), (50, rows[51][1], 2), (None, rows[50][1], 5), (None, rows[100][1], 4)]
    rows += [(2000, None, 1), (2001, rows[0][1], None), (2002, [float("nan")] * 8, 1), (2003, [None, 1.0], 1), (2050, [float("inf")] * 8, 1), (2004, [], 1), (2100, [], 2), (2150, [1.0, 2.0], 4), (2151, [1.0, 1.5], 4), (2152, [1.0, 1.0], 5)]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).coalesce(1)
    got = clean(hn.query(frame).collect())
    assert got == clean(expected(rows)) and len(got) > 60


def test_without_rows_or_anchors(spark):
    assert hn.query(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.query(spark.createDataFrame([(1, [1.0], 1, 0, "")], SCHEMA)).count() == 0


@pytest.mark.parametrize("d,bits", [(2, 3), (3, 2), (1, 3), (4, 1)])
def test_curve_visits_neighbours(d, bits):
    """Each cell once, and from cell to cell one step along one dimension."""
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    keys = hn.hilbert_keys(cells, bits)
    walk = cells[sorted(range(len(cells)), key=lambda k: keys[k])]
    assert len(set(keys)) == len(cells)
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_row():
    rng = np.random.default_rng(5)
    x, a = rng.integers(-300, 300, (50, 6)), rng.integers(-300, 300, (20, 6))
    least, most = hn.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    assert (least <= a @ x.T).all() and (a @ x.T <= most).all()


def test_zones_rule_out_blocks(spark, monkeypatch):
    """Separate clusters: an anchor reads few of the blocks."""
    monkeypatch.setattr(hn, "BLOCK", 20)
    rng = np.random.default_rng(6)
    rows = [(k, (np.eye(4)[k % 4] * 3 + 0.05 * rng.standard_normal(4)).tolist(), int(k % 4)) for k in range(400)]
    blocks = hn.candidate_blocks(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    zones = hn.zone_maps(blocks)
    anchors = blocks.where("vec_id = 100").select(F.lit(0).cast("long").alias("slice"), "row", "label", "d", "q").withColumn("least", F.lit(256 * 256 * 8).cast("long"))
    chosen = {r.block for r in hn.choose(anchors, zones, 1, 1, hn._choose_positives, 5).collect()}
    assert 5 <= len(chosen) < zones.select("block").distinct().count() / 2
