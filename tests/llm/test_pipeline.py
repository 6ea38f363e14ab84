"""The pipeline and the registered queries on the small tables, where they are present."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_stages(spark):
    import corpus_pipeline
    from caseloom.llm.scratch import cut

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
            left = docs.count()
            assert 0 < left <= seen
            seen = left
    assert docs.select("doc_id").distinct().count() == seen


def test_registered(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
