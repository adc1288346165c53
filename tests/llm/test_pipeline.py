import os

import pytest

import corpus_pipeline
from revoicer.llm import neardup, quality

SF = "/root/testdata/sf0.001"


def test_stages_call_what_they_name():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pipeline_by_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    left = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert len(rows) == len(ids) and ids <= left
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality.assess(docs).collect() if r.kept}
        if name == "near_duplicates":
            assert ids == {r.class_id for r in neardup.near_duplicates(docs).collect()}
        docs, left = spark.createDataFrame(rows, out.schema), ids
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == left
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
