"""IO07: whether two copies of a bank are the same, by counts and one digest, and where they differ.

A bank's digest is the root of a tree over ranges of its key: a range of WIDTH
keys has the digest of its rows in order of key, a range above has that of its
FANOUT parts. Trees are compared from the root, and only below ranges that
differ; rows are read of the differing ranges alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, FANOUT, LEVELS = 64, 16, 6
#: Differing ranges that are asked for by bounds, which reach the files' statistics; more of them are joined.
MOST_BOUNDS = 200
NOTHING = "∅"


def canonical(df: DataFrame, fields: list[str]) -> Column:
    """Fields and options (id=text=key) of a row as one text; nulls are marked."""
    said = [F.coalesce(F.col(f).cast("string"), F.lit(NOTHING)) for f in fields]
    if "options" in df.columns:
        said.append(F.array_join(F.transform("options", lambda o: F.concat_ws("=", F.coalesce(o["id"], F.lit(NOTHING)), F.coalesce(o["text"], F.lit(NOTHING)), o["is_correct"].cast("string"))), "\x1e"))
    return F.concat_ws("\x1f", *said)


def range_of(key: str, level: int = 0) -> Column:
    """Number of the key's range; keys below zero and nulls have ranges of their own."""
    return F.coalesce(F.floor(F.col(key) / F.lit(WIDTH * FANOUT**level)).cast("long"), F.lit(-(1 << 62)))


def key_tree(df: DataFrame, fields: list[str], key: str = "case_id") -> DataFrame:
    """level, part, n, digest: ranges of WIDTH keys, and LEVELS ranges above them, the top one over all.

    Rows of one key are in order of their digests; equal rows come together
    with their number, so that repeats of a row are one entry of its range.
    """
    rows = df.select(key, F.sha2(canonical(df, fields), 256).alias("digest")).groupBy(key, "digest").agg(F.count(F.lit(1)).alias("n"))
    item = F.struct(F.col(key).alias("key"), "digest", "n")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["digest"], x["n"].cast("string"))), "")
    level = rows.groupBy(range_of(key).alias("part")).agg(F.sum("n").alias("n"), F.sha2(line, 256).alias("digest"))
    level = level.select(F.lit(0).alias("level"), "part", "n", "digest")
    tree = level
    for k in range(1, LEVELS + 1):
        above = F.floor(F.col("part") / FANOUT).cast("long") if k < LEVELS else F.lit(0).cast("long")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: F.concat(x["part"].cast("string"), F.lit(":"), x["digest"])), ",")
        level = level.groupBy(above.alias("up")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest")).select(F.lit(k).alias("level"), F.col("up").alias("part"), "n", "digest")
        tree = tree.unionByName(level)
    return tree


def keep_tree(tree: DataFrame, path: str) -> DataFrame:
    """A tree written once, its levels in folders of their own, and read back."""
    tree.write.partitionBy("level").parquet(path)
    return tree.sparkSession.read.schema(tree.schema).parquet(path)


def differing_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """part: the lowest ranges that differ. Each level reads only the parts of differing ranges above it."""
    parts = None
    for level in range(LEVELS, -1, -1):
        x, y = (t.where(F.col("level") == level).select("part", F.col("digest").alias(name)) for t, name in ((a, "x"), (b, "y")))
        if parts is not None:
            up = F.floor(F.col("part") / FANOUT).cast("long") if level + 1 < LEVELS else F.lit(0).cast("long")
            x, y = (t.withColumn("up", up).join(parts, "up", "left_semi").drop("up") for t in (x, y))
        found = x.join(y, "part", "full_outer").where("x is null or y is null or x <> y").select(F.col("part").alias("up"))
        if level > 0:
            found = found.checkpoint() if parts is not None else found
        parts = found
    return parts.select(F.col("up").alias("part"))


def rows_of(df: DataFrame, ranges: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows of ``df`` in the ranges: by bounds of the key where there are few, which skips files and row groups."""
    few = [r[0] for r in ranges.limit(MOST_BOUNDS + 1).collect()]
    if len(few) > MOST_BOUNDS:
        return df.withColumn("_part", range_of(key)).join(ranges.select(F.col("part").alias("_part")), "_part", "left_semi").drop("_part")
    picked = F.lit(False)
    for part in sorted(few):
        picked = picked | (F.col(key).isNull() if part == -(1 << 62) else F.col(key).between(part * WIDTH, part * WIDTH + WIDTH - 1))
    return df.where(picked)


@dataclass
class Copy:
    """A bank with its tree."""

    rows: DataFrame
    tree: DataFrame


def counts(df: DataFrame) -> DataFrame:
    """part, value, n: cases, options, keys, and cases by source and by status, from one scan."""
    right = F.size(F.filter("options", lambda o: o["is_correct"]))
    narrow = df.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce(F.size("options"), F.lit(0)).alias("o"), F.coalesce(right, F.lit(0)).alias("k"))
    grouped = narrow.groupingSets([["source"], ["status"], []], "source", "status").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("o").alias("o"), F.sum("k").alias("k"))
    by = grouped.where("g > 0 and g < 3").select(F.when(F.col("g") == 1, "source").otherwise("status").alias("part"), F.coalesce(F.when(F.col("g") == 1, F.col("source")).otherwise(F.col("status")), F.lit("")).alias("value"), "n")
    total = grouped.where("g = 3").select(F.explode(F.create_map(F.lit("cases"), "n", F.lit("options"), F.coalesce("o", F.lit(0)).cast("long"), F.lit("keys"), F.coalesce("k", F.lit(0)).cast("long"))).alias("part", "n"))
    return by.unionByName(total.select("part", F.lit("").alias("value"), "n"))


def verify_copy(a: Copy, b: Copy) -> DataFrame:
    """part, value, a, b, matches: every count of both copies, and their digests (as part ``digest``, of which a and b are the sizes)."""
    x, y = counts(a.rows).withColumnRenamed("n", "a"), counts(b.rows).withColumnRenamed("n", "b")
    both = x.join(y, ["part", "value"], "full_outer").select("part", "value", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    root = lambda c, n: c.tree.where(F.col("level") == LEVELS).agg(F.max("digest").alias(f"d{n}"), F.coalesce(F.sum("n"), F.lit(0)).alias(n))
    digest = root(a, "a").crossJoin(root(b, "b"))  # one row each
    digest = digest.select(F.lit("digest").alias("part"), F.lit("").alias("value"), "a", "b", F.col("da").eqNullSafe(F.col("db")).alias("matches"))
    return both.withColumn("matches", F.col("a") == F.col("b")).unionByName(digest)
