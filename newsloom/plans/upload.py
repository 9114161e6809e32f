"""Ingest of one pair of files into the stored tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.embedder import HashedWords
from newsloom.operators import ingest
from newsloom.runtime import scratch, settle
from newsloom.sources import jsonl
from newsloom.sources.store import Store, append_run, complete_runs, open_store


@dataclass
class Upload:
    """Rows to add to each table, and the articles refused with their reason."""

    rows: Store
    refused: DataFrame


def plan_upload(
    store: Store,
    category: DataFrame,
    summaries: DataFrame,
    category_order: list[str],
    summary_order: list[str],
    run_time: datetime,
    make_embedder=HashedWords,
) -> Upload:
    """Work out what an upload adds. ``run_time`` fills both time stamps."""
    told = ingest.listed_summaries(category, summaries, store.articles, summary_order)
    # Articles are chosen and numbered by narrow rows; the texts stay in ``told``.
    judged = told.select(*dict.fromkeys(["link_hash", *summary_order, *ingest.JUDGED]))
    fresh = ingest.new_articles(category, judged, store.articles, category_order, summary_order, ingest.JUDGED)
    checked = settle(ingest.with_link_taken(ingest.with_violation(fresh), store.articles), "checked")
    accepted = checked.where("reason IS NULL")
    used = ingest.highest(store.articles, "article_id")
    articles = settle(ingest.with_article_ids(accepted, used), "articles")

    texts = ingest.texts_of(articles, told)
    pairs = ingest.article_tag_pairs(texts)
    used = ingest.highest(store.tags, "tag_id")
    wanted = settle(ingest.wanted_tags(pairs, store.tags), "wanted_tags")
    tags = settle(ingest.new_tags(wanted, used), "tags")
    needed = ingest.known_tags(wanted).unionByName(tags)
    used = ingest.highest(store.key_insights, "key_insight_id")
    insights = ingest.insight_rows(texts, used)
    first = articles.agg(F.min("article_id")).first()[0] or 0
    used = ingest.highest(store.embeddings, "embedding_id")
    vectors = ingest.embedded(texts, make_embedder).withColumn(
        "embedding_id", F.col("article_id") - first + used + 1
    )

    stamp = F.lit(run_time.isoformat(sep=" ")).cast("timestamp_ntz")

    def shaped(name: str, rows: DataFrame) -> DataFrame:
        stamped = rows.withColumn("created_at", stamp).withColumn("updated_at", stamp)
        return stamped.select(*schemas.STORE[name].names)

    rows = Store(
        articles=shaped("articles", articles),
        tags=shaped("tags", tags),
        article_tags=shaped("article_tags", ingest.bridge(pairs, needed, wanted.count(), wanted)),
        key_insights=shaped("key_insights", insights),
        embeddings=shaped("embeddings", vectors),
    )
    return Upload(rows, ingest.refused_rows(checked.where("reason IS NOT NULL"), told))


def upload(
    path: str,
    run: int,
    category: DataFrame,
    summaries: DataFrame,
    category_order: list[str],
    summary_order: list[str],
    run_time: datetime,
    make_embedder=HashedWords,
) -> None:
    """Add one run to the store at ``path``. Runs are numbered upwards; repeating the
    last one replaces it, and a lower one is refused. Refused articles go to ``refused`` beside the tables."""
    spark = category.sparkSession
    newest = max(complete_runs(spark, path), default=run)
    if run < newest:
        raise ValueError(f"run {run} is below the newest complete run {newest} of {path}")
    with scratch(spark):
        store = open_store(spark, path, before_run=run)
        planned = plan_upload(
            store, category, summaries, category_order, summary_order, run_time, make_embedder
        )
        planned.refused.write.mode("overwrite").parquet(f"{path}/refused/run={run}")
        append_run(planned.rows, path, run)


def upload_files(
    spark: SparkSession,
    path: str,
    run: int,
    category_file: str,
    summary_file: str,
    run_time: datetime,
    make_embedder=HashedWords,
) -> None:
    """Add the articles of a category file and a summary file, the first row of a link wins.
    Lines that cannot be read go with their reason to ``unread`` beside the tables."""
    category = jsonl.checked_lines(spark, category_file, schemas.CATEGORY_FILE, ("date",))
    summaries = jsonl.checked_lines(spark, summary_file, schemas.SUMMARY_FILE)
    unread = [
        rows.where("reason IS NOT NULL").select(F.lit(name).alias("file"), "value", "reason")
        for name, rows in (("category", category), ("summary", summaries))
    ]
    sound = [rows.where("reason IS NULL").drop("reason", "value") for rows in (category, summaries)]
    upload(path, run, *sound, jsonl.PLACES, jsonl.PLACES, run_time, make_embedder)
    unread[0].unionByName(unread[1]).write.mode("overwrite").parquet(f"{path}/unread/run={run}")
