"""One request at a time: the batch plans run on a table of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.embedder import HashedWords
from newsloom.functions.links import link_hash, normalized_link
from newsloom.operators import search_requests
from newsloom.plans.search import DEFAULT_LIMIT, hybrid_search, lookup_articles
from newsloom.sources.store import Store


def search_by_tag_names(
    store: Store, tag_names: str | None, limit: int = DEFAULT_LIMIT, make_embedder=HashedWords
) -> DataFrame:
    """Hybrid search for tags written with commas between them."""
    spark = store.articles.sparkSession
    asked = spark.createDataFrame([(1, tag_names)], "query_id bigint, tag_names string")
    checked = search_requests.validate_searches(asked)
    refused = checked.where("reason IS NOT NULL").select("reason").first()
    if refused:
        raise ValueError(refused["reason"])
    return hybrid_search(store, search_requests.embed_searches(checked, make_embedder), limit).drop("query_id")


def article_by_link_hash(store: Store, key: str | None) -> Row | None:
    """The stored article with this key, or None."""
    if not key:
        raise ValueError(search_requests.LINK_HASH_REQUIRED)
    spark = store.articles.sparkSession
    keys = spark.createDataFrame([(key,)], "link_hash string")
    return lookup_articles(store, keys).where("found").drop("found").first()


def make_hashed_link(spark: SparkSession, link: str) -> str:
    """The key of a link as the keying request spells it."""
    row = (
        spark.createDataFrame([(link,)], "link string")
        .select(normalized_link(F.col("link")).alias("link"))
        .select("link", link_hash("link").alias("link_hash"))
        .first()
    )
    if row["link"] is None:
        raise ValueError(f"not an http or https link: {link}")
    return row["link_hash"]
