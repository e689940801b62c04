"""What packing sends from the driver needs no Python on the executors besides its own tasks."""

import public_tokenizers
import pyspark

from entityspark.llm import packing


def test_no_table_is_made_by_python_tasks(spark, monkeypatch):
    """A table from a list is deserialised by Python tasks of another kind, whose daemon stays on each executor."""

    def made(*given, **options):
        raise AssertionError("a table from a list")

    monkeypatch.setattr(pyspark.SparkContext, "parallelize", made)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
