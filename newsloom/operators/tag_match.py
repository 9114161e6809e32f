"""Articles that carry requested tags, and the best of them per request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import BROADCAST_BYTES, BROADCAST_IDS, settle, small, small_if_counted

# Shares of the tag sets of one request that are ranked apart before the last ranking.
SHORTLIST_SHARES = 64


@dataclass
class Asked:
    """Requested tags that the store knows: (query_id, tag_id, tag), and at most how many."""

    rows: DataFrame
    at_most: int

    def tag_ids(self) -> DataFrame:
        return small(self.rows.select("tag_id").distinct(), self.at_most, BROADCAST_IDS)

    def hinted(self) -> DataFrame:
        return small(self.rows, self.at_most)


def requested_tags(requests: DataFrame, tags: DataFrame) -> Asked:
    """Each tag once per request. Tags match exactly, whatever their length."""
    named = requests.select("query_id", F.explode(F.array_distinct("tags")).alias("tag"))
    at_most, size = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("tag") + 16), F.lit(0))).first()
    hinted = named if size > BROADCAST_BYTES else F.broadcast(named)
    known = tags.select("tag_id", "tag").join(hinted, "tag")
    return Asked(settle(known.select("query_id", "tag_id", "tag"), "asked"), at_most)


def tagged_rows(article_tags: DataFrame, asked: Asked) -> DataFrame:
    """(article_id, tag_id) for the requested tags only, read without shuffling the bridge."""
    return article_tags.select("article_id", "tag_id").join(asked.tag_ids(), "tag_id", "left_semi")


def tag_matches(tagged: DataFrame, asked: Asked) -> DataFrame:
    """All matches: (query_id, article_id, tag_names), distinct tags in order.

    Articles that carry the same requested tags match alike, and so do requests for the
    same tags. Each kind of article is matched with each kind of request once; the
    matches, as many as requests times articles, come out of the last joins unshuffled.
    """
    carried = settle(carried_tags(tagged), "carried")
    wanted = asked.rows.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("tag", "tag_id"))).alias("wanted"))
    wanted = settle(wanted, "wanted")
    kinds = wanted.select("wanted").distinct().select("wanted", F.inline("wanted"))
    alike = carried.select("carried").distinct().select("carried", F.explode("carried").alias("tag_id"))
    matched = (
        alike.join(kinds, "tag_id")
        .groupBy("carried", "wanted")
        .agg(F.sort_array(F.collect_set("tag")).alias("tag_names"))
    )
    matched = small_if_counted(settle(matched, "matched-kinds"))
    return (
        carried.join(matched, "carried")
        .join(small(wanted, asked.at_most), "wanted")
        .select("query_id", "article_id", "tag_names")
    )


def carried_tags(tagged: DataFrame) -> DataFrame:
    """(article_id, carried): ids of the tags of any request that an article carries."""
    return tagged.groupBy("article_id").agg(F.sort_array(F.collect_set("tag_id")).alias("carried"))


def best_tagged(carried: DataFrame, asked: Asked, k: int) -> DataFrame:
    """The ``k`` articles with most matched tags per request, ties to the smaller article_id.

    Articles that carry the same requested tags match every request alike, so ``k``
    of them per tag set decide every ranking; a tag carried by a third of the
    corpus costs ``k`` rows and not a third of the corpus per request.
    """
    same = Window.partitionBy("carried").orderBy("article_id")
    heads = (
        carried.withColumn("_place", F.row_number().over(same))
        .where(f"_place <= {k}")
        .groupBy("carried")
        .agg(F.sort_array(F.collect_list("article_id")).alias("ids"))
    )
    matched = (
        heads.select("carried", "ids", F.explode("carried").alias("tag_id"))
        .join(asked.hinted(), "tag_id")
        .groupBy("query_id", "carried", "ids")
        .agg(F.sort_array(F.collect_set("tag")).alias("tag_names"))
        .withColumn("n_tags", F.size("tag_names"))
    )
    per_request = Window.partitionBy("query_id")
    sets_first = per_request.orderBy(F.desc("n_tags"), F.col("ids")[0])
    articles_first = per_request.orderBy(F.desc("n_tags"), "article_id")
    return (
        shortlist(matched, k)
        .withColumn("_place", F.row_number().over(sets_first))
        .where(f"_place <= {k}")
        .select("query_id", "n_tags", "tag_names", F.explode("ids").alias("article_id"))
        .withColumn("_place", F.row_number().over(articles_first))
        .where(f"_place <= {k}")
        .select("query_id", "article_id", "tag_names")
    )


def shortlist(matched: DataFrame, k: int) -> DataFrame:
    """The ``k`` best tag sets of each request within each of SHORTLIST_SHARES shares.

    Every set of a request's overall ``k`` best is among the ``k`` best of its share, so
    the last ranking sees at most ``k`` x SHORTLIST_SHARES rows per request, however many
    sets carry one frequent tag; the shares are ranked in tasks of their own.
    """
    share = F.pmod(F.xxhash64("carried"), F.lit(SHORTLIST_SHARES))
    within = Window.partitionBy("query_id", "_share").orderBy(F.desc("n_tags"), F.col("ids")[0])
    return (
        matched.withColumn("_share", share)
        .withColumn("_place", F.row_number().over(within))
        .where(f"_place <= {k}")
        .drop("_share", "_place")
    )


def own_tags(carried: DataFrame, pairs: DataFrame, asked: Asked) -> DataFrame:
    """(query_id, article_id, own_tags): requested tags of the given (query_id, article_id)
    pairs; pairs without any are left out. ``pairs`` carries its own broadcast hint."""
    return (
        carried.join(pairs, "article_id")
        .select("query_id", "article_id", F.explode("carried").alias("tag_id"))
        .join(asked.hinted(), ["query_id", "tag_id"])
        .groupBy("query_id", "article_id")
        .agg(F.sort_array(F.collect_set("tag")).alias("own_tags"))
    )
