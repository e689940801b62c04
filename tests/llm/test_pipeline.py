"""The pipeline's stages take effect on what the stage before kept."""

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now and (ids is None or now <= ids)
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
