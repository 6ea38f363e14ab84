"""Sequential numbers without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import ensure_checkpoint_dir


def dense_numbers(df: DataFrame, order: list[str | Column], name: str, keys: list[str] | None = None) -> DataFrame:
    """PR11: 1, 2, 3 ... in ``order`` (which should be unique), for each value of ``keys``; nulls come first, of any type.

    Rows are sorted by ranges of (keys, order) and written to the checkpoint
    folder with their place; the counts of the ranges before are added. So a
    key that holds most rows is no single task, and only counts meet in one.
    """
    keys = keys or []
    ensure_checkpoint_dir(df.sparkSession)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    line = [*keys, *order]
    placed = df.repartitionByRange(parts, *line).sortWithinPartitions(*line).withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("_range", F.shiftrightunsigned("_place", 33))
    sizes = placed.groupBy(*keys, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(offsets, same).withColumn(name, F.col("_before") + F.col("_place") - F.col("_first") + 1).select(*df.columns, name)


def assign_case_codes(cases: DataFrame) -> DataFrame:
    """WN01: SRC-CAT-TYP-00001, numbered in input order within (source, category, type)."""
    part = lambda c, fallback: F.rpad(F.upper(F.substring(F.regexp_replace(F.coalesce(c, F.lit(fallback)), "[^A-Za-z0-9]", ""), 1, 3)), 3, "X")
    coded = cases.withColumn("_src", part(F.regexp_replace("source", "src", "S"), "UNK")).withColumn("_cat", part(F.col("category"), "GEN")).withColumn("_typ", part(F.col("exam_type"), "MCQ"))
    numbered = dense_numbers(coded, ["pos"], "_n", ["_src", "_cat", "_typ"])
    return numbered.withColumn("case_code", F.concat_ws("-", "_src", "_cat", "_typ", F.lpad(F.col("_n").cast("string"), 5, "0"))).drop("_src", "_cat", "_typ", "_n")
