"""From raw documents to packed training sequences: five stages, each written before the next.

Every stage works on all that the one before it kept, and all but the last give rows
with the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import jaccard, packing, secrets, suffixes, toxicity
from newsloom.llm.queries import tokenizer
from newsloom.runtime import fresh_path, prepare, scratch

# Shortest repeated stretch that is cut out: a passage of fifty short words.
PASSAGE_BYTES = 240


def _measured(docs: DataFrame) -> DataFrame:
    """Bring ``n_chars`` up to date with a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the ordinal model rejects."""
    prepare(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that shares three quarters of its five-word shingles."""
    prepare(spark)
    return jaccard.one_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document, or an earlier place, has already; every document stays."""
    prepare(spark)
    return _measured(suffixes.without_repeats(docs, PASSAGE_BYTES))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; every document stays."""
    prepare(spark)
    return _measured(secrets.redact_secrets(docs, secrets.fit_secrets(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_duplicates),
    ("suffix-array dedup", without_repeated_passages),
    ("secret scans", without_secrets),
    ("packing", packed),
]

# Trained models, suffix order and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; the result of each is written and read back.

    What a stage wrote on its way is deleted when its result stands.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
