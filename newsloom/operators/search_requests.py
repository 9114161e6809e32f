"""Validation of search and lookup requests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.embedder import HashedWords, embed
from newsloom.functions.text import split_tags, tags_as_text
from newsloom.runtime import settle

TAGS_REQUIRED = "tag_names is required"
LINK_HASH_REQUIRED = "link_hash is required"


def validate_searches(requests: DataFrame) -> DataFrame:
    """Add ``reason`` (null when accepted), ``tags`` and ``query_text`` to (…, tag_names)."""
    given = F.coalesce(F.col("tag_names"), F.lit("")) != ""
    tags = split_tags(F.col("tag_names"))
    return (
        requests.withColumn("reason", F.when(~given, TAGS_REQUIRED))
        .withColumn("tags", F.when(given, tags))
        .withColumn("query_text", F.when(given, tags_as_text(tags)))
    )


def validate_lookups(requests: DataFrame) -> DataFrame:
    """Add ``reason`` (null when accepted) to (…, link_hash)."""
    given = F.coalesce(F.col("link_hash"), F.lit("")) != ""
    return requests.withColumn("reason", F.when(~given, LINK_HASH_REQUIRED))


def embed_searches(validated: DataFrame, make_embedder=HashedWords) -> DataFrame:
    """Accepted searches with their vectors: (query_id, tags, query_vec).

    Written once, as a search reads its requests several times and embedding is costly.
    """
    vector = embed(F.col("query_text"), make_embedder).cast("array<double>")
    accepted = validated.where("reason IS NULL")
    return settle(accepted.select("query_id", "tags", vector.alias("query_vec")), "searches")
