"""Response files that arrive over time, ingested as they come."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.embedder import HashedWords
from newsloom.operators.responses import classify_responses, quarantined, summaries
from newsloom.plans.upload import upload
from newsloom.runtime import scratch, settle, small_if_counted
from newsloom.sources.jsonl import PLACES, exists
from newsloom.sources.store import complete_runs


def ingest_arrivals(
    spark: SparkSession,
    responses_dir: str,
    category: DataFrame,
    category_order: list[str],
    store_path: str,
    progress_path: str,
    run_time: datetime,
    make_embedder=HashedWords,
    files_per_batch: int | None = None,
    first_run: int = 0,
) -> None:
    """Ingest the response files that have arrived since the last call, then return.

    A batch is one run of the store, numbered ``first_run`` plus the number of the
    batch: when a batch is repeated after a failure it replaces its own rows, and
    articles of earlier runs are not added again. ``progress_path`` belongs to the
    store; with a new one give a ``first_run`` above the runs the store has, a lower one
    is refused.
    """
    if not exists(spark, progress_path) and max(complete_runs(spark, store_path), default=-1) >= first_run:
        raise ValueError(f"new progress folder, but {store_path} has runs from {first_run} on")
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(responses_dir).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )

    def ingest_batch(batch: DataFrame, batch_id: int) -> None:
        run = first_run + batch_id
        placed = batch.withColumn("line_order", F.monotonically_increasing_id())
        with scratch(spark):
            classified = settle(classify_responses(placed), "arrived")
            parsed = summaries(classified, *PLACES)
            answered = small_if_counted(parsed.select("link_hash").distinct())
            listed = category.join(answered, "link_hash", "left_semi")
            upload(
                store_path, run, listed, parsed, category_order, PLACES, run_time, make_embedder
            )
            quarantined(classified).write.mode("overwrite").parquet(
                f"{store_path}/quarantine/run={run}"
            )

    query = (
        lines.writeStream.foreachBatch(ingest_batch)
        .option("checkpointLocation", progress_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
