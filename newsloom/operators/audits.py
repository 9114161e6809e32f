"""Integrity of the stored tables: unique keys, foreign keys, cascading deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import small_if_counted
from newsloom.sources.store import Store

# Unique keys and foreign keys of the stored tables.
UNIQUE = {
    "articles_link_hash": ("articles", ["link_hash"]),
    "articles_link": ("articles", ["link"]),
    "tags_tag": ("tags", ["tag"]),
    "article_tags_pair": ("article_tags", ["article_id", "tag_id"]),
    "key_insights_pair": ("key_insights", ["key_insight", "article_id"]),
}
PRIMARY = {
    "articles_id": ("articles", ["article_id"]),
    "tags_id": ("tags", ["tag_id"]),
    "key_insights_id": ("key_insights", ["key_insight_id"]),
    "embeddings_id": ("embeddings", ["embedding_id"]),
    "one_embedding_per_article": ("embeddings", ["article_id"]),
}
FOREIGN = {
    "article_tags_article": ("article_tags", "article_id", "articles"),
    "article_tags_tag": ("article_tags", "tag_id", "tags"),
    "key_insights_article": ("key_insights", "article_id", "articles"),
    "embeddings_article": ("embeddings", "article_id", "articles"),
}


def _shown(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _by_article(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same keys, dealt by article: an article's rows, which lie together, are shuffled as one list."""
    (other,) = (c for c in columns if c != "article_id")
    held = rows.groupBy("article_id").agg(F.collect_list(other).alias("_held"))
    return held.select("article_id", F.explode("_held").alias(other))


def unique_audit(store: Store) -> DataFrame:
    """(rule, key, n_rows) of every key held by more than one row; null keys never clash."""
    found = []
    for rule, (table, columns) in {**UNIQUE, **PRIMARY}.items():
        rows = getattr(store, table).dropna(subset=columns)
        if len(columns) > 1:
            rows = _by_article(rows, columns)
        repeated = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
        found.append(repeated.select(F.lit(rule).alias("rule"), _shown(columns).alias("key"), "n_rows"))
    return reduce(DataFrame.unionByName, found)


def orphan_audit(store: Store) -> DataFrame:
    """(rule, key, n_rows) of every foreign key without its parent.

    Children are counted per key first, so a parent with very many children is one row in the join.
    """
    found = []
    for rule, (child, column, parent) in FOREIGN.items():
        keys = getattr(store, child).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
        orphans = keys.join(getattr(store, parent).select(column), column, "left_anti")
        found.append(orphans.select(F.lit(rule).alias("rule"), F.col(column).alias("key"), "n_rows"))
    return reduce(DataFrame.unionByName, found)


def cascade_delete(
    store: Store, article_ids: DataFrame | None = None, tag_ids: DataFrame | None = None
) -> Store:
    """The store without the given articles and tags and without all that depends on them."""
    tables = {name: getattr(store, name) for name in Store.names()}

    def drop(names: list[str], gone: DataFrame, key: str) -> None:
        keys = small_if_counted(gone.select(key).distinct())
        for name in names:
            tables[name] = tables[name].join(keys, key, "left_anti")

    if article_ids is not None:
        drop(["articles", "article_tags", "key_insights", "embeddings"], article_ids, "article_id")
    if tag_ids is not None:
        drop(["tags", "article_tags"], tag_ids, "tag_id")
    return Store(**tables)
