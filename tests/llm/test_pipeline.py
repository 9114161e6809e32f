import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark, hard_rows):
    from newsloom.runtime import settle

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    hard = spark.createDataFrame([(i if i is None else i + 10_000, t, None, "x", len(t or "")) for i, t in hard_rows], docs.schema)
    docs = docs.unionByName(hard)
    columns, labels = docs.columns, spark.read.parquet(f"{FOLDER}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, FOLDER), name.replace(" ", "-"))
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            gone = before.join(docs.select("doc_id"), "doc_id", "left_anti").join(labels, "doc_id")
            # Fitted on a few dozen labels, the model may err on single clean documents.
            clean = before.join(labels.where("toxic = 0"), "doc_id").count()
            assert gone.where("toxic = 0").count() <= 0.05 * clean
        if name in ("suffix-array dedup", "secret scans"):
            assert docs.count() == before.count()
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("most"))
    assert pieces.where("doc_id IS NOT NULL AND n <> most").count() == 0


def test_no_documents(spark, no_docs):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, empty, FOLDER)
        assert rows.count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_no_clean_document_is_dropped(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = corpus_pipeline.without_toxic(spark, docs, FOLDER)
    gone = docs.join(kept.select("doc_id"), "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() == 0
