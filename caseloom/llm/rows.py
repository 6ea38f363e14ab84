"""Numbers for rows, where several rows share an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: Rows of shared ids are numbered from here on, by a hash of id and text.
SHARED = 1 << 62


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def shared_ids(docs: DataFrame) -> DataFrame | None:
    """doc_id and whether its texts differ, of ids that several rows have; None where there are none."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key")).where("doc_id is not null")
    many = keys.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), (F.min("key") < F.max("key")).alias("differ")).where("rows > 1")
    many = cut(many.select("doc_id", "differ"), "shared-ids")
    return None if many.isEmpty() else many


def numbered(docs: DataFrame, shared: DataFrame | None, name: str) -> DataFrame:
    """``docs`` with a number of each row: its id, or one of its own where different texts share the id."""
    own = F.col("doc_id").cast("long")
    if shared is None:
        return docs.withColumn(name, own)
    differ = shared.where("differ").select(F.col("doc_id").alias(f"{name}_shared"))
    number = F.when(F.col(f"{name}_shared").isNull(), own).otherwise(F.lit(SHARED) + F.pmod(F.xxhash64(own, "text"), F.lit(SHARED)))
    return docs.join(differ, own == F.col(f"{name}_shared"), "left").withColumn(name, number).drop(f"{name}_shared")


def without_repeats(docs: DataFrame, shared: DataFrame | None) -> DataFrame:
    """Of rows with equal id and text one stays."""
    if shared is None:
        return docs
    ids = shared.select("doc_id")
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns).unionByName(docs.join(ids, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
