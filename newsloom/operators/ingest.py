"""New articles and their rows in the five tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.embedder import HashedWords, embed
from newsloom.operators.frequent import join_by_frequency
from newsloom.operators.numbering import hash_digits, number_rows
from newsloom.runtime import BROADCAST_BYTES, BROADCAST_IDS, PACKED, dealt, settle, small

LISTED = ["link", "link_hash", "headline", "date"]
TOLD = ["summarization", "tags", "key_insights"]
JOINED = [*LISTED, *TOLD]
# What stands for a summary while articles are chosen: its row, and what its texts break.
JUDGED = ["row", "faults", "n_repeated_insights"]
# Rows to number (tags, insights) in one task, about 100 MB of insights.
ROWS_PER_TASK = 500_000
# Articles of an upload so small that it may have come in one file: their texts are spread over all tasks.
SPREAD_KEYS = 10_000


def join_inputs(category: DataFrame, summaries: DataFrame, told: list[str] = TOLD) -> DataFrame:
    """Category rows with the ``told`` columns of their summaries; repeated keys multiply."""
    joined = category.withColumn("date", F.col("date").try_cast("date")).join(summaries, "link_hash")
    return joined.select(*LISTED, *told)


def listed_summaries(
    category: DataFrame, summaries: DataFrame, stored_articles: DataFrame, summary_order: list[str]
) -> DataFrame:
    """The summaries that an upload may need, written once: each with its number (``row``)
    and the columns that judge it (JUDGED), so that nobody has to move its texts to choose.

    Keys that are not listed, or stored already, are left out while the rest can be
    told by hash from a broadcast; a key that shares its hash only stays in.
    """
    key = F.xxhash64("link_hash").alias("_key")
    open_keys = category.select("link_hash").join(stored_articles.select("link_hash"), "link_hash", "left_anti")
    open_keys = settle(open_keys.select(key).distinct(), "open-keys")
    n = open_keys.count()
    if n <= BROADCAST_IDS:
        hashed = summaries.withColumn("_key", key)
        summaries = hashed.join(small(open_keys, n, BROADCAST_IDS), "_key", "left_semi")
    if n <= SPREAD_KEYS:
        summaries = summaries.repartition(summaries.sparkSession.sparkContext.defaultParallelism)
    columns = dict.fromkeys(["link_hash", *summary_order, *TOLD])
    faults = F.struct(*[broken.alias(name) for name, broken in text_faults().items()])
    return settle(
        summaries.select(
            *columns,
            F.monotonically_increasing_id().alias("row"),
            faults.alias("faults"),
            repeated_insights().alias("n_repeated_insights"),
        ),
        "summaries",
        codec=PACKED,
    )


def texts_of(chosen: DataFrame, summaries: DataFrame) -> DataFrame:
    """(article_id, summarization, tags, key_insights) of the chosen articles (``row, article_id``).
    The ids go to the texts, which stay where they are unless there are too many articles."""
    ids = chosen.select("row", "article_id")
    n = ids.count()
    texts = summaries.join(small(ids, n, BROADCAST_IDS), "row").select("article_id", *TOLD)
    return texts if n <= BROADCAST_IDS else settle(texts, "texts", codec=PACKED)


def refused_rows(refused: DataFrame, summaries: DataFrame) -> DataFrame:
    """The refused articles with their texts; only these are shuffled."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("link", "link_hash", "headline")), F.lit(50))
    n, size = refused.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    texts = summaries.select("row", *TOLD).join(small(refused.select("row"), n, BROADCAST_IDS), "row", "left_semi")
    whole = texts.join(small(refused, size, BROADCAST_BYTES), "row")
    return whole.select(*JOINED, "reason", "n_repeated_insights")


def first_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key. Repeats are pruned before the shuffle."""
    by_key = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(by_key)).where("_nth = 1").drop("_nth")


def new_articles(
    category: DataFrame,
    summaries: DataFrame,
    stored_articles: DataFrame,
    category_order: list[str],
    summary_order: list[str],
    told: list[str] = TOLD,
) -> DataFrame:
    """Joined rows that are not stored yet, the first one for each link_hash.

    The first row of the join is the join of the first rows, so repeated keys
    never multiply.
    """
    joined = join_inputs(
        first_rows(category, "link_hash", category_order),
        first_rows(summaries, "link_hash", summary_order),
        told,
    )
    return joined.join(stored_articles.select("link_hash"), "link_hash", "left_anti")


def _too_long(column: str, limit: int) -> Column:
    return F.length(column) > limit


def text_faults() -> dict[str, Column]:
    """The limits of the store that a summary breaks, by the columns of TOLD."""
    return {
        "tag_too_long": F.exists("tags", lambda t: F.length(t) > schemas.MAX_TAG),
        "key_insight_too_long": F.exists("key_insights", lambda k: F.length(k) > schemas.MAX_KEY_INSIGHT),
        "summarization_missing": F.col("summarization").isNull(),
        "tag_missing": F.exists("tags", lambda t: t.isNull()),
        "key_insight_missing": F.exists("key_insights", lambda k: k.isNull()),
    }


def violation(texts: dict[str, Column] | None = None) -> Column:
    """The first limit of the store that a joined row breaks; null when it fits. ``texts``
    are the faults of its texts where the row does not hold them."""
    texts = texts or text_faults()
    limits = {"link_hash": schemas.MAX_LINK_HASH, "link": schemas.MAX_LINK, "headline": schemas.MAX_HEADLINE}
    checks = {f"{name}_too_long": _too_long(name, limit) for name, limit in limits.items()}
    checks |= {name: texts[name] for name in ("tag_too_long", "key_insight_too_long")}
    checks |= {f"{name}_missing": F.col(name).isNull() for name in ("link_hash", "link", "headline", "date")}
    checks |= {name: texts[name] for name in ("summarization_missing", "tag_missing", "key_insight_missing")}
    reason = F.lit(None).cast("string")
    for name, broken in reversed(checks.items()):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return reason


def repeated_insights() -> Column:
    repeated = F.size("key_insights") - F.size(F.array_distinct("key_insights"))
    return F.when(F.col("key_insights").isNull(), 0).otherwise(repeated)


def with_violation(joined: DataFrame) -> DataFrame:
    """Add ``reason`` and the number of insights that repeat an earlier one. Rows without
    their texts (JUDGED) have that number already."""
    if "faults" in joined.columns:
        return joined.withColumn("reason", violation({name: F.col(f"faults.{name}") for name in text_faults()}))
    return joined.withColumn("reason", violation()).withColumn("n_repeated_insights", repeated_insights())


def with_link_taken(checked: DataFrame, stored_articles: DataFrame) -> DataFrame:
    """Refuse articles whose link is stored or stands at an earlier key of the upload.

    Of several keys with one link the smallest is taken. Rows refused for another
    reason take no link.
    """
    links = checked.where("reason IS NULL").groupBy("link").agg(F.min("link_hash").alias("_first"))
    stored = stored_articles.select("link", F.lit(True).alias("_stored")).distinct()
    taken = F.col("reason").isNull() & (F.col("_stored").isNotNull() | (F.col("link_hash") != F.col("_first")))
    return (
        checked.join(links, "link", "left")
        .join(stored, "link", "left")
        .withColumn("reason", F.when(taken, "link_taken").otherwise(F.col("reason")))
        .select(*checked.columns)
    )


def highest(table: DataFrame, column: str) -> int:
    """The largest id in use, 0 for an empty table."""
    return table.agg(F.max(column)).first()[0] or 0


def number_new(df: DataFrame, id_name: str, hex_key: Column, order: list[str], used: int) -> DataFrame:
    """Give ids after ``used``, gap-free, in the order of a hash of the natural key.

    The hash spreads the rows evenly over the buckets; unlike hashes as ids, numbers
    never collide. It is worked out again after the shuffle, which moves the bare rows.
    """
    rows = df.count()
    digits = hash_digits(hex_key, rows)

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_hex": hex_key, "bucket": digits})

    numbered = number_rows(keyed(dealt(df, rows, ROWS_PER_TASK, digits)), ["bucket"], ["_hex", *order], sized=keyed(df))
    return numbered.withColumn(id_name, F.col("row_index") + used + 1).drop(
        "_hex", "bucket", "row_index"
    )


def with_article_ids(fresh: DataFrame, used: int) -> DataFrame:
    return number_new(fresh, "article_id", F.md5("link_hash"), ["link_hash"], used)


def article_tag_pairs(articles: DataFrame) -> DataFrame:
    """(article_id, tag), each tag once per article; no shuffle, the list is in the row."""
    return articles.select("article_id", F.explode(F.array_distinct("tags")).alias("tag"))


def wanted_tags(pairs: DataFrame, stored_tags: DataFrame) -> DataFrame:
    """(tag, n, tag_id) of the distinct tags of an upload and how many pairs have them; new
    ones have no id yet."""
    tags = pairs.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.join(stored_tags.select("tag", "tag_id"), "tag", "left")


def new_tags(wanted: DataFrame, used: int) -> DataFrame:
    """(tag, tag_id) of the wanted tags that are not stored yet."""
    unknown = wanted.where("tag_id IS NULL").select("tag")
    return number_new(unknown, "tag_id", F.md5("tag"), ["tag"], used)


def known_tags(wanted: DataFrame) -> DataFrame:
    return wanted.where("tag_id IS NOT NULL").select("tag", "tag_id")


def bridge(pairs: DataFrame, tags: DataFrame, n_tags: int, counts: DataFrame | None = None) -> DataFrame:
    """(article_id, tag_id). ``tags`` holds each tag once, ``n_tags`` is their number.

    A vocabulary within the broadcast limit leaves the pairs where they are; beyond
    it only pairs of rare tags are shuffled. ``counts`` (``tag, n``) saves counting.
    """
    return join_by_frequency(pairs, tags.select("tag_id", "tag"), n_tags, "tag", counts).select("article_id", "tag_id")


def insight_rows(articles: DataFrame, used: int) -> DataFrame:
    """(key_insight_id, key_insight, article_id), each insight once per article."""
    rows = articles.select(
        "article_id", F.explode(F.array_distinct("key_insights")).alias("key_insight")
    )
    key = F.md5(F.concat_ws("|", F.col("article_id").cast("string"), "key_insight"))
    return number_new(rows, "key_insight_id", key, ["article_id", "key_insight"], used)


def embedding_changes(incoming: DataFrame, stored_embeddings: DataFrame) -> DataFrame:
    """(article_id, summarization, change) of the texts to embed: new ones and changed ones."""
    stored = stored_embeddings.select(
        "article_id", F.col("summarization").alias("_old"), F.lit(True).alias("_known")
    )
    same = F.col("summarization").eqNullSafe(F.col("_old"))
    change = F.when(F.col("_known").isNull(), "new").when(~same, "changed")
    return (
        incoming.select("article_id", "summarization")
        .join(stored, "article_id", "left")
        .withColumn("change", change)
        .where("change IS NOT NULL")
        .select("article_id", "summarization", "change")
    )


def embedded(changes: DataFrame, make_embedder=HashedWords) -> DataFrame:
    """Add the ``embedding`` of each summarization."""
    return changes.withColumn("embedding", embed(F.col("summarization"), make_embedder))
