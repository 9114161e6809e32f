"""What an upload moves and writes at size: narrow rows, and texts once."""

import re
from datetime import datetime
from functools import partial

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from newsloom.functions.embedder import HashedWords
from newsloom.operators import ingest
from newsloom.operators.frequent import join_by_frequency, least_frequent
from newsloom.plans import upload
from newsloom.runtime import dealt, scratch
from newsloom.sources.store import empty_store, open_store

from corpus import articles, category_rows, key, summary_rows
from spark_plans import plan_of

EMBEDDER = partial(HashedWords, 64)
NOW = datetime(2024, 5, 6)
TEXTS = {"summarization", "tags", "key_insights"}


def moved(df) -> list[set[str]]:
    """The columns that each shuffle of a plan moves."""
    formatted = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(formatted)
    inputs = re.findall(r"\(\d+\) Exchange\nInput(?: \[\d+\])?: \[([^\]]*)\]", text)
    return [set(re.findall(r"(\w+)#\d+", line)) for line in inputs]


def send(spark, path, run, category, summaries):
    upload.upload(path, run, category, summaries, ["line"], ["line"], NOW, EMBEDDER)
    return open_store(spark, path)


def content(store):
    names = store.articles.select("article_id", "link_hash")
    return {
        "articles": sorted(map(tuple, store.articles.select("article_id", "link_hash", "link", "headline").collect())),
        "tags": sorted(map(tuple, store.tags.select("tag_id", "tag").collect())),
        "article_tags": sorted(map(tuple, store.article_tags.select("article_id", "tag_id").collect())),
        "key_insights": sorted(map(tuple, store.key_insights.select("key_insight_id", "key_insight", "article_id").collect())),
        "embeddings": sorted(map(tuple, store.embeddings.join(names, "article_id").select("link_hash", "embedding_id", "summarization").collect())),
    }


def test_articles_are_chosen_without_moving_their_texts(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ingest, "SPREAD_KEYS", 0)  # only texts of a small upload are spread
    for module in (upload, ingest):
        def kept(df, *rest, settle=upload.settle, **options):
            plans.append(df)
            return settle(df, *rest, **options)

        monkeypatch.setattr(module, "settle", kept)
    with scratch(spark):
        planned = upload.plan_upload(empty_store(spark), category_rows(spark), summary_rows(spark), ["line"], ["line"], NOW, EMBEDDER)
        plans += [planned.rows.article_tags, planned.rows.key_insights, planned.rows.embeddings]
        shuffles = [columns for df in plans for columns in moved(df)]
        assert any("link_hash" in columns for columns in shuffles)
        assert not [columns for columns in shuffles if columns & TEXTS]
        assert planned.rows.embeddings.count() == 17


def test_numbers_move_bare_rows(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "article_id long, key_insights array<string>")
    numbered = ingest.insight_rows(rows, 6)
    assert {"article_id", "key_insight"} in moved(numbered)
    assert not [columns for columns in moved(numbered) if {"key_insight", "_hex"} <= columns]
    assert sorted(r.key_insight_id for r in numbered.collect()) == [7, 8, 9]


def test_more_articles_than_a_broadcast_holds(spark, tmp_path, monkeypatch):
    rows = articles()
    rows[4]["headline"] = None
    # The same summary twice at one place, and one listed that has none.
    told = summary_rows(spark, rows[:15])
    told = told.unionByName(told.where("line % 3 = 0"))
    first = content(send(spark, str(tmp_path / "a"), 0, category_rows(spark, rows), told))
    assert len(first["articles"]) == len(first["embeddings"]) == 14
    assert {r[1] for r in first["articles"]} == {r["link_hash"] for r in rows[:15] if r["headline"]}
    monkeypatch.setattr(ingest, "BROADCAST_IDS", 3)
    monkeypatch.setattr(ingest, "BROADCAST_BYTES", 3)
    path = str(tmp_path / "b")
    assert content(send(spark, path, 0, category_rows(spark, rows), told)) == first
    refused = spark.read.parquet(f"{path}/refused").collect()
    assert [(r.link_hash, r.reason, r.summarization, r.tags, r.key_insights, r.n_repeated_insights) for r in refused] == [
        (key(rows[4]["link"]), "headline_missing", rows[4]["summarization"], rows[4]["tags"], rows[4]["key_insights"], 0)
    ]


@pytest.mark.parametrize("limit", [0, 1, 2, 4, 100])
def test_rare_and_frequent_keys_give_the_whole_join(spark, limit):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate("aaaaaaaabbbbcc" "de")] + [(None, 99)], "k string, i long")
    table = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), ("e", 5), ("x", 6), (None, 7)], "k string, v long")
    plain = sorted(map(tuple, rows.join(table, "k").collect()))
    assert sorted(map(tuple, join_by_frequency(rows, table, 7, "k", limit=limit).collect())) == plain


def test_rows_of_frequent_keys_stay(spark):
    counts = spark.createDataFrame([("a", 8), ("b", 4), ("c", 2), ("d", 1), ("e", 1)], "k string, n long")
    assert [least_frequent(counts, n) for n in (0, 1, 2, 3, 4, 5)] == [16, 8, 4, 2, 2, 1]
    rows = spark.createDataFrame([(k, 0) for k in "aaaaaaaabbbbcc" "de"], "k string, i long")
    joined = join_by_frequency(rows, counts.select("k", F.lit(1).alias("v")), 5, "k", limit=2)
    plan = plan_of(joined)
    assert "BroadcastHashJoin [k" in plan and "LeftAnti" in plan
    assert "hashpartitioning(k" not in plan.split("SortMergeJoin")[0]


def test_wide_rows_are_dealt_by_their_number(spark):
    assert dealt(spark.range(100), 100, 10, "id").rdd.getNumPartitions() == 10
    assert "REPARTITION_BY_COL" in plan_of(dealt(spark.range(100), 100, 100, "id"))


def test_stored_tables_are_packed(spark, tmp_path):
    send(spark, str(tmp_path), 0, category_rows(spark), summary_rows(spark))
    for name in ("embeddings", "key_insights"):
        file = next((tmp_path / name / "run=0").glob("*.parquet"))
        assert pq.ParquetFile(file).metadata.row_group(0).column(1).compression == "ZSTD"
