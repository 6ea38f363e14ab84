"""The corpus pipeline: five operators, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import ngram_join, packing, rows, secrets, suffix_dedup, toxicity
from caseloom.llm.scratch import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; the chain is fitted on the labelled ones."""
    chain = toxicity.fit_corpus(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = docs.columns
    return toxicity.score(docs, chain, keep=names).where(~toxicity.is_toxic()).select(*names)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 80 percent), the document with the smallest id.

    Of rows with equal id and text one stays; different texts that share an id
    are documents of their own, behind all others. Rows without an id stay.
    """
    shared = rows.shared_ids(docs)
    number = rows.fresh("row", docs.columns)
    numbered = rows.numbered(rows.without_repeats(docs, shared), shared, number)
    found = ngram_join.ngram_components(numbered.select(F.col(number).alias("doc_id"), "text"), n=5, percent=80)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(number))
    return numbered.join(gone, number, "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; documents of nothing else go."""
    spans = cut(suffix_dedup.repeated_passages(docs), "passages")
    return suffix_dedup.cut_repeats(docs, spans)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found secret, other than widely copied ones, replaced by its kind in brackets."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", cut_repeated_passages),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained models and token ids cannot be written in SQL; tests compare the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
