"""The Merkle manifest against a plain recursion."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from caseloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, path int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def climb(digests):
    """Root, and for each leaf its (before, after) steps."""
    paths = [[] for _ in digests]
    covers = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        groups = [range(k, min(k + 3, len(digests))) for k in range(0, len(digests), 3)]
        for g in groups:
            for k in g:
                for x in covers[k]:
                    paths[x].append(("".join(digests[j] for j in g if j < k), "".join(digests[j] for j in g if j > k)))
        digests, covers = [sha(*[digests[k] for k in g]) for g in groups], [[x for k in g for x in covers[k]] for g in groups]
    return digests[0], paths


def expected(rows):
    by_source = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        other = leaf(r, None if r[1] is None else r[1].replace("\n", "")) if changed else None
        by_source.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), other or "", r[0]))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s]) for s in order}
    subs = {s: climb([x[1] for x in trees[s]]) for s in order}
    root, above = climb([subs[s][0] for s in order])
    out = []
    for s, over in zip(order, above):
        for x, path in zip(trees[s], subs[s][1]):
            path = path + over
            now = x[2] or x[1]
            for before, after in path:
                now = sha(before, now, after)
            out.append((x[3], x[1], subs[s][0], root, sha(*[b + a for b, a in path]), now, now == root))
    return out


def sort(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 2}, {"hot": 90, "": 1, "ß": 4, "z": 10, None: 1}])
def test_manifest(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "BAND", 2)
    monkeypatch.setattr(merkle, "TASK", 8)
    monkeypatch.setattr(merkle, "CHUNK", 7)
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = [None, "", "a\nb\n", "long \n" * 500, "äöü"][k % 5]
            rows.append((None if k == 6 else k, text, "en" if k % 4 else None, source, None if k == 3 else len(text or ""), "clash", 1))
            k += 1
    rows += [rows[-1], rows[0]]
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sort(got) == sort(expected(rows))


def test_empty_and_root_alone(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nodes_cover_their_leaves(spark):
    """Every interval is the union of its children's, and a changed leaf changes just the nodes that contain it."""
    leaves = spark.range(1000).selectExpr("0L as tree", "id as place", "1000L as n", "sha2(cast(id as string), 256) as digest", "id as doc_id", "cast(null as string) as other")
    changed = leaves.withColumn("digest", F.when(F.col("place") == 500, F.sha2(F.lit("x"), 256)).otherwise(F.col("digest")))
    a, b = ({(r.level, r.lo, r.hi): r.digest for r in merkle.grow(f, 1000, 1000).all_nodes().collect()} for f in (leaves, changed))
    assert a.keys() == b.keys() and max(level for level, _, _ in a) == 7
    assert {k for k in a if a[k] != b[k]} == {k for k in a if k[1] <= 500 < k[2]}
    assert all(sum(h - lo for level, lo, h in a if level == wanted) == 1000 for wanted in range(1, 8))
