from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.embedder import HashedWords
from newsloom.plans import revisions
from newsloom.runtime import fresh_path
from newsloom.sources.store import Store, append_run, compact, empty_store, open_store

STAMP = datetime(2024, 1, 1)


def first_store(spark):
    """Three articles with tags, insights and embedding rows, written as run 0."""
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    stamped = lambda rows, name: spark.createDataFrame(rows, schemas.STORE[name]).withColumns({"created_at": at, "updated_at": at})
    d = datetime(2020, 1, 1).date()
    rows = Store(
        articles=stamped([(i, f"h{i}", f"l{i}", f"t{i}", d, None, None) for i in (1, 2, 3)], "articles"),
        tags=stamped([(10, "zoo", None, None), (11, "sea", None, None)], "tags"),
        article_tags=stamped([(1, 10, None, None), (2, 10, None, None), (2, 11, None, None), (3, 11, None, None)], "article_tags"),
        key_insights=stamped([(100 + i, f"insight {i}", i, None, None) for i in (1, 2, 3)], "key_insights"),
        embeddings=stamped([(200 + i, f"text {i}", i, [0.0] * 4, None, None) for i in (1, 2, 3)], "embeddings"),
    )
    path = fresh_path(spark, "store")
    append_run(rows, path, 0)
    return path


def rows_of(store):
    return {name: sorted(map(tuple, getattr(store, name).collect())) for name in Store.names()}


def test_revise_then_delete_then_compact(spark):
    path = first_store(spark)
    revised = spark.createDataFrame([(1, "new one"), (1, "another one"), (2, "text 2"), (9, "unknown")], "article_id long, summarization string")
    refused = revisions.revise_summaries(path, 1, revised, datetime(2024, 2, 1), HashedWords)
    assert [tuple(r) for r in refused.collect()] == [(9, "no stored summary")]
    store = open_store(spark, path)
    by_id = {r.article_id: r for r in store.embeddings.collect()}
    assert by_id[1].summarization == "new one" and by_id[1].embedding_id == 201
    assert by_id[1].created_at == datetime(2024, 1, 1) and by_id[1].updated_at == datetime(2024, 2, 1)
    assert by_id[2].updated_at == datetime(2024, 1, 1)  # the same text makes no version
    assert any(x != 0 for x in by_id[1].embedding) and store.embeddings.count() == 3
    before = rows_of(open_store(spark, path, before_run=1))
    assert {r[1] for r in before["embeddings"]} == {"text 1", "text 2", "text 3"}

    revisions.delete_articles(path, 2, spark.createDataFrame([(2,), (2,), (None,), (7,)], "article_id long"))
    store = open_store(spark, path)
    assert sorted(r.article_id for r in store.articles.collect()) == [1, 3]
    assert sorted((r.article_id, r.tag_id) for r in store.article_tags.collect()) == [(1, 10), (3, 11)]
    assert store.tags.count() == 2 and store.key_insights.count() == 2 and store.embeddings.count() == 2
    resolved = rows_of(store)

    compact(spark, path, 3, remove=True)
    assert rows_of(open_store(spark, path)) == resolved
    with pytest.raises(ValueError):
        compact(spark, path, 3)


def test_a_version_after_a_tombstone_stands(spark):
    path = first_store(spark)
    revisions.delete_articles(path, 1, spark.createDataFrame([(3,)], "article_id long"))
    at = F.lit("2024-03-01").cast("timestamp_ntz")
    again = spark.createDataFrame([(3, "h3", "l3", "back", datetime(2021, 1, 1).date(), None, None)], schemas.ARTICLES).withColumns({"created_at": at, "updated_at": at})
    append_run(Store(**{**vars(empty_store(spark)), "articles": again}), path, 2, changes=True)
    heads = {r.article_id: r.headline for r in open_store(spark, path).articles.collect()}
    assert heads == {1: "t1", 2: "t2", 3: "back"}
    assert {r.article_id: r.headline for r in open_store(spark, path, before_run=2).articles.collect()} == {1: "t1", 2: "t2"}


def test_runs_below_the_newest_are_refused(spark):
    path = first_store(spark)
    revisions.delete_articles(path, 2, spark.createDataFrame([(1,)], "article_id long"))
    with pytest.raises(ValueError):
        revisions.delete_articles(path, 1, spark.createDataFrame([(2,)], "article_id long"))
