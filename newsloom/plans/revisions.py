"""Change runs of the store: revised summaries with new vectors, and deleted articles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.embedder import HashedWords
from newsloom.operators import ingest
from newsloom.runtime import scratch, settle
from newsloom.sources.store import Store, append_run, complete_runs, empty_store, open_store


def _checked_run(spark, path: str, run: int) -> None:
    newest = max(complete_runs(spark, path), default=run - 1)
    if run < newest:
        raise ValueError(f"run {run} is below the newest complete run {newest} of {path}")


def revise_summaries(
    path: str, run: int, revised: DataFrame, run_time: datetime, make_embedder=HashedWords
) -> DataFrame:
    """Store new summaries (``article_id, summarization``) as new versions of their
    embedding rows: vector made again, ``created_at`` kept, ``updated_at`` = ``run_time``.

    An unchanged text (nulls equal) makes no version. Of several texts for one article
    the greatest wins. Articles without a stored embedding row are refused and returned
    (``article_id, reason``), as are written beside the tables.
    """
    spark = revised.sparkSession
    _checked_run(spark, path, run)
    with scratch(spark):
        store = open_store(spark, path, before_run=run)
        latest = revised.groupBy("article_id").agg(F.max("summarization").alias("summarization"))
        stored = store.embeddings.select("embedding_id", "article_id", F.col("summarization").alias("_old"), "created_at")
        joined = settle(latest.join(stored, "article_id", "left"), "revisions")
        refused = joined.where("embedding_id IS NULL").select("article_id", F.lit("no stored summary").alias("reason"))
        changed = joined.where(F.col("embedding_id").isNotNull() & ~F.col("summarization").eqNullSafe(F.col("_old")))
        stamp = F.lit(run_time.isoformat(sep=" ")).cast("timestamp_ntz")
        vectors = ingest.embedded(changed, make_embedder).withColumn("updated_at", stamp)
        rows = Store(**{**vars(empty_store(spark)), "embeddings": vectors.select(*schemas.EMBEDDINGS.names)})
        append_run(rows, path, run, changes=True)
        refused.write.mode("overwrite").parquet(f"{path}/refused/run={run}")
    return spark.read.parquet(f"{path}/refused/run={run}")


def delete_articles(path: str, run: int, gone: DataFrame) -> None:
    """Tombstones for the articles (``article_id``) that stand, as a cascade, for their tag
    links, insights and embedding rows as well; tags stay. Unknown ids change nothing."""
    spark = gone.sparkSession
    _checked_run(spark, path, run)
    with scratch(spark):
        ids = settle(gone.select("article_id").where("article_id IS NOT NULL").distinct(), "gone")
        append_run(empty_store(spark), path, run, gone=ids)
