"""The registered queries: each runs one or more operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import links, vectors
from newsloom.functions.embedder import HashedWords
from newsloom.operators import audits, cells, extract, ingest, pages, requests, responses
from newsloom.operators.frequent import join_by_frequency
from newsloom.operators.insights import insights_per_article
from newsloom.operators.nearest import nearest
from newsloom.operators.search_requests import validate_lookups, validate_searches
from newsloom.plans import preparation, revisions, search, upload
from newsloom.runtime import BROADCAST_KEYS, fresh_path, settle, small_if_counted
from newsloom.sources import jsonl
from newsloom.sources.store import Store, append_run, compact, open_store
from newsloom.streaming.arrivals import ingest_arrivals
from newsloom.workload.adapters import STORED_BEFORE, Tables

RUN_TIME = datetime(2024, 1, 1)
LIMIT = 10
CELLS, NPROBE = 8, 4
VECTOR_WIDTH = 64

CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def case(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    CASES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def shown(values: Column, name: str) -> Column:
    """A list as one text, so that both engines compare it alike."""
    return F.array_join(values, "|").alias(name)


# Search


@case
def hybrid_search(t: Tables) -> DataFrame:
    found = search.hybrid_search(t.written_store(), t.searches(), LIMIT)
    lists = [shown(F.col(c), c) for c in ("tag_names", "key_insights")]
    return found.select(*[c for c in found.columns if c not in ("tag_names", "key_insights")], *lists)


@case
def semantic_topk(t: Tables) -> DataFrame:
    return search.semantic_topk(t.written_store(), t.searches(), LIMIT).withColumn(
        "distance", F.round("distance", 4)
    )


@case
def lexical_topk(t: Tables) -> DataFrame:
    return search.lexical_topk(t.written_store(), t.searches(), LIMIT).select(
        "query_id", "article_id", shown(F.col("tag_names"), "tag_names"),
        F.size("tag_names").cast("bigint").alias("n_tags"), F.round("distance", 4).alias("distance"),
    )


@case
def tag_match(t: Tables) -> DataFrame:
    return search.all_tag_matches(t.written_store(), t.searches()).select(
        "query_id", "article_id", shown(F.col("tag_names"), "tag_names")
    )


@case
def insights_agg(t: Tables) -> DataFrame:
    return insights_per_article(t.store().key_insights).select(
        "article_id", shown(F.col("key_insights"), "key_insights")
    )


@case
def cosine_distance(t: Tables) -> DataFrame:
    """Every vector against the one before it, as stored and scaled to unit length."""
    left = t.read("embeddings").select("vec_id", F.col("embedding").alias("a"))
    right = t.read("embeddings").select(
        (F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return left.join(right, "vec_id").select(
        "vec_id",
        F.round(vectors.cosine_distance(a, b), 4).alias("distance"),
        F.round(1.0 - vectors.dot(vectors.unit(a), vectors.unit(b)), 4).alias("unit_distance"),
    )


@case
def ann_topk(t: Tables) -> DataFrame:
    """Cells around each label's mean vector; a request searches the NPROBE nearest."""
    mean = t.read("embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    mean = mean.groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One row per label: the centres of the cells.
    rows = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("m")).orderBy("label").collect()
    index = cells.place_in_cells(t.store().embeddings, np.array([[p.x for p in r.m] for r in rows]))
    return cells.nearest_in_cells(index, t.searches(), LIMIT, NPROBE).withColumn("distance", F.round("distance", 4))


@case
def ann_topk_all_cells(t: Tables) -> DataFrame:
    """Searching every cell must give the exact answer."""
    index = cells.build_cells(t.store().embeddings, CELLS, seed=1)
    found = cells.nearest_in_cells(index, t.searches(), LIMIT, CELLS)
    return found.withColumn("distance", F.round("distance", 4))


@case
def ann_recall(t: Tables) -> DataFrame:
    """What the cell search finds of the exact answer, with the share of comparisons it makes."""
    embeddings, asked = t.store().embeddings, t.searches()
    index = cells.build_cells(embeddings, CELLS, seed=1)
    found = cells.nearest_in_cells(index, asked, LIMIT, NPROBE)
    share = cells.scanned_share(index, asked, NPROBE)
    return cells.recall(found, nearest(embeddings, asked, LIMIT)).withColumn("scanned_share", F.lit(share))


@case
def article_lookup(t: Tables) -> DataFrame:
    """Every article by its key, with its summary whether or not it has a vector, and keys that no article has."""
    found = search.lookup_articles(t.written_store(all_summaries=True), t.lookup_keys())
    lists = [shown(F.col(c), c) for c in ("tag_names", "key_insights")]
    return found.select(*[c for c in found.columns if c not in ("tag_names", "key_insights")], *lists)


@case
def request_validate(t: Tables) -> DataFrame:
    searches = validate_searches(t.search_texts())
    lookups = validate_lookups(t.search_texts().withColumnRenamed("tag_names", "link_hash"))
    return searches.join(lookups.select("query_id", F.col("reason").alias("lookup_reason")), "query_id").select(
        "query_id", "reason", shown(F.col("tags"), "tags"),
        F.size("tags").cast("bigint").alias("n_tags"), "query_text", "lookup_reason",
    )


# Ingest


def _fresh(t: Tables) -> DataFrame:
    return ingest.new_articles(
        t.category_rows(), t.summary_rows(), t.stored_articles(), ["line"], ["line"]
    )


def _fresh_with_ids(t: Tables) -> DataFrame:
    used = ingest.highest(t.stored_articles(), "article_id")
    return settle(ingest.with_article_ids(settle(_fresh(t), "fresh"), used), "numbered")


@case
def ingest_join(t: Tables) -> DataFrame:
    return ingest.join_inputs(t.category_rows(), t.summary_rows()).select(
        "link", "link_hash", "headline", "date", "summarization",
        shown(F.col("tags"), "tags"), shown(F.col("key_insights"), "key_insights"),
    )


@case
def ingest_new_articles(t: Tables) -> DataFrame:
    return _fresh(t).select("link_hash", "link", "headline", "date")


@case
def ingest_articles(t: Tables) -> DataFrame:
    used = ingest.highest(t.stored_articles(), "article_id")
    return ingest.with_article_ids(settle(_fresh(t), "fresh"), used).select(
        "article_id", "link_hash", "link", "headline", "date"
    )


@case
def ingest_new_tags(t: Tables) -> DataFrame:
    stored = t.stored().tags
    wanted = settle(ingest.wanted_tags(t.article_tag_names(t.articles()), stored), "wanted_tags")
    return ingest.new_tags(wanted, ingest.highest(stored, "tag_id")).select("tag_id", "tag")


@case
def ingest_article_tags(t: Tables) -> DataFrame:
    articles = _fresh_with_ids(t)
    pairs = ingest.article_tag_pairs(articles)
    stored = t.stored().tags
    wanted = settle(ingest.wanted_tags(pairs, stored), "wanted_tags")
    added = ingest.new_tags(wanted, ingest.highest(stored, "tag_id"))
    return ingest.bridge(pairs, ingest.known_tags(wanted).unionByName(added), wanted.count())


@case
def ingest_key_insights(t: Tables) -> DataFrame:
    return ingest.insight_rows(_fresh_with_ids(t), 0).select(
        "key_insight_id", "key_insight", "article_id"
    )


def _tags_by_link(store: Store, keys: DataFrame) -> DataFrame:
    """(link_hash, value): the tags of every article. The narrow pairs meet the tags first,
    so that only tags are shuffled with them and the long link hashes once, at the end."""
    tags = join_by_frequency(
        store.article_tags.select("article_id", "tag_id"), store.tags.select("tag_id", "tag"), store.tags.count(), "tag_id"
    )
    return tags.join(keys, "article_id").select("link_hash", F.col("tag").alias("value"))


@case
def ingest_run(t: Tables) -> DataFrame:
    """Two uploads into a new store, the first one repeated: all rows by their natural keys."""
    path = fresh_path(t.spark, "store")
    embedder = partial(HashedWords, VECTOR_WIDTH)
    category = t.category_rows()
    early = category.where(F.col("date") < F.lit(STORED_BEFORE).cast("date"))
    for run, rows in ((0, early), (0, early), (1, category)):
        upload.upload(path, run, rows, t.summary_rows(), ["line"], ["line"], RUN_TIME, embedder)
    store = open_store(t.spark, path)
    keys = small_if_counted(store.articles.select("article_id", "link_hash"), BROADCAST_KEYS)
    vector = F.transform("embedding", lambda x: F.round(x.cast("double") * 1e4).cast("bigint"))
    parts = {
        "articles": store.articles.select("link_hash", F.concat_ws("|", "link", "headline", F.col("date").cast("string")).alias("value")),
        "tags": store.tags.select(F.lit("").alias("link_hash"), F.col("tag").alias("value")),
        "article_tags": _tags_by_link(store, keys),
        "key_insights": store.key_insights.join(keys, "article_id").select("link_hash", F.col("key_insight").alias("value")),
        "embeddings": store.embeddings.join(keys, "article_id").select(
            "link_hash", F.concat_ws("|", "summarization", F.size(vector).cast("string")).alias("value")
        ),
    }
    return reduce(
        DataFrame.unionByName, [rows.select(F.lit(name).alias("table_name"), "link_hash", "value") for name, rows in parts.items()]
    )


@case
def embed_delta(t: Tables) -> DataFrame:
    """Texts to embed again when the stored French texts are out of date, with the vectors."""
    articles = t.stored_articles()
    old = F.when(F.col("category") == "fr", F.concat(F.lit("old "), "summarization"))
    stored = articles.select(
        "article_id", F.coalesce(old, F.col("summarization")).alias("summarization")
    )
    changes = ingest.embedding_changes(t.articles(), stored)
    numbers = F.transform("embedding", lambda x: F.round(x.cast("double") * 1e4).cast("bigint"))
    return ingest.embedded(changes, partial(HashedWords, VECTOR_WIDTH)).select(
        "article_id", "change", shown(numbers, "embedding")
    )


@case
def constraint_check(t: Tables) -> DataFrame:
    return ingest.with_violation(t.faulty_rows()).select(
        "article_id", "reason", F.col("n_repeated_insights").cast("bigint").alias("n_repeated_insights")
    )


@case
def unique_audit(t: Tables) -> DataFrame:
    """Audit of all articles together with the English ones once more."""
    everything, again = t.written_store(), t.written_store(t.articles().where("category = 'en'"))
    both = Store(
        *[getattr(everything, n).unionByName(getattr(again, n)) for n in Store.names()]
    )
    return audits.unique_audit(both).withColumn("key", F.md5("key"))


@case
def orphan_audit(t: Tables) -> DataFrame:
    """Audit after the articles and tags of later days were lost."""
    everything, early = t.written_store(), t.written_store(t.stored_articles())
    return audits.orphan_audit(
        Store(early.articles, early.tags, everything.article_tags, everything.key_insights, everything.embeddings)
    )


@case
def cascade_delete(t: Tables) -> DataFrame:
    """Delete the articles in French and every tag of the German ones: rows left per article."""
    articles = t.articles()
    gone_tags = t.store(articles.where("category = 'de'")).tags
    left = audits.cascade_delete(t.written_store(), articles.where("category = 'fr'"), gone_tags)
    tables = ["articles", "article_tags", "key_insights", "embeddings"]
    counts = [
        getattr(left, name).groupBy("article_id").agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "article_id", "n_rows"
        )
        for name in tables
    ]
    return reduce(DataFrame.unionByName, counts)


REVISED_AT = datetime(2024, 2, 1)


def _changed_store(t: Tables) -> str:
    """A store of all articles (run 0), then the summaries of articles labelled of low
    quality revised (run 1), then the articles labelled toxic deleted (run 2)."""
    path = fresh_path(t.spark, "store")
    stamp = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = t.store()
    append_run(Store(*[getattr(rows, n).withColumns({"created_at": stamp, "updated_at": stamp}) for n in Store.names()]), path, 0)
    labels = t.read("labels")
    low = t.articles().join(labels.where("quality = 0").select(F.col("doc_id").alias("article_id")), "article_id", "left_semi")
    revised = low.select("article_id", F.concat("summarization", F.lit(" revised")).alias("summarization"))
    revisions.revise_summaries(path, 1, revised, REVISED_AT, partial(HashedWords, VECTOR_WIDTH))
    revisions.delete_articles(path, 2, labels.where("toxic = 1").select(F.col("doc_id").alias("article_id")))
    return path


@case
def store_revisions(t: Tables) -> DataFrame:
    """Embedding rows read back after revisions and deletions: texts, vectors and time stamps."""
    store = open_store(t.spark, _changed_store(t))
    numbers = F.transform("embedding", lambda x: F.round(x.cast("double") * 1e4).cast("bigint"))
    return store.embeddings.select(
        "article_id", "embedding_id", "summarization", shown(numbers, "embedding"),
        F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at"),
    )


@case
def store_compaction(t: Tables) -> DataFrame:
    """All rows of the five tables, by natural keys, after the changes are compacted into a base run."""
    path = _changed_store(t)
    compact(t.spark, path, 3, remove=True)
    store = open_store(t.spark, path)
    keys = small_if_counted(store.articles.select("article_id", "link_hash"), BROADCAST_KEYS)
    stamp = lambda c: F.col(c).cast("string")
    parts = {
        "articles": store.articles.select("link_hash", F.concat_ws("|", "link", "headline", F.col("date").cast("string")).alias("value")),
        "tags": store.tags.select(F.lit("").alias("link_hash"), F.col("tag").alias("value")),
        "article_tags": _tags_by_link(store, keys),
        "key_insights": store.key_insights.join(keys, "article_id").select("link_hash", F.col("key_insight").alias("value")),
        "embeddings": store.embeddings.join(keys, "article_id").select(
            "link_hash", F.concat_ws("|", "summarization", stamp("created_at"), stamp("updated_at")).alias("value")
        ),
    }
    return reduce(
        DataFrame.unionByName, [rows.select(F.lit(name).alias("table_name"), "link_hash", "value") for name, rows in parts.items()]
    )


# Preparation


@case
def extract_filter(t: Tables) -> DataFrame:
    return extract.select_category(t.dump(), "en", date(2015, 1, 1))


@case
def link_keys(t: Tables) -> DataFrame:
    return t.read("pages").select(
        "page_id",
        links.link_hash("url").alias("link_hash"),
        links.link_hash(links.normalized_link(F.col("url"))).alias("normalized_hash"),
    )


@case
def link_parts(t: Tables) -> DataFrame:
    """Page links with the host in capitals, some cut down to the bare host, some without
    scheme, the others with dot segments before their path."""
    spelled = (
        F.when(F.col("page_id") % 3 == 0, F.regexp_extract("url", "^(https?://[^/]+)", 1))
        .when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^https?://", ""))
        .otherwise(F.regexp_replace("url", "^(https?://[^/]+)/", "$1/./gone/../%2E%2e/"))
    )
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    link = F.replace(spelled, host, F.upper(host))
    return t.read("pages").select(
        "page_id",
        links.is_valid_link(link).alias("is_valid"),
        links.link_host(link).alias("host"),
        links.normalized_link(link).alias("normalized"),
    )


@case
def page_status(t: Tables) -> DataFrame:
    return pages.page_status(t.pages()).select("page_id", "link", "status")


@case
def page_text(t: Tables) -> DataFrame:
    return pages.page_text(t.pages()).select("page_id", "link", "content", "status")


@case
def request_build(t: Tables) -> DataFrame:
    numbered = requests.requests_from_table(t.contents(), "doc_id")
    return numbered.select(
        "doc_id", F.col("chunk_number").cast("bigint").alias("chunk_number"),
        "request_number", "custom_id", "reason",
    )


@case
def request_counts(t: Tables) -> DataFrame:
    return requests.request_counts(t.contents().withColumn("reason", requests.rejection()))


@case
def request_files(t: Tables) -> DataFrame:
    """Content lines written out, one of them broken per chunk of the order, then read and requested."""
    path = fresh_path(t.spark, "content") + ".jsonl"
    line = F.to_json(F.struct("link", "content", "link_hash"))
    broken = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    t.contents().orderBy("doc_id").select(broken.alias("value")).write.text(path)
    out = fresh_path(t.spark, "chunks")
    preparation.prepare_requests(t.spark, path, out, fresh_path(t.spark, "refused") + ".jsonl")
    parsed = F.from_json("value", "custom_id string, body struct<model string, messages array<struct<role string, content string>>>")
    written = t.spark.read.schema("value string, chunk_number int").text(out).select(parsed.alias("r"), "chunk_number")
    text = F.col("r.body.messages")[1]["content"]
    custom_id = F.split("r.custom_id", "_")
    return written.select(
        F.element_at(custom_id, 3).alias("link_hash"),
        text.alias("content"),
        F.col("chunk_number").cast("bigint").alias("chunk_number"),
        F.element_at(custom_id, 4).cast("bigint").alias("request_number"),
    )


@case
def response_parse(t: Tables) -> DataFrame:
    return responses.classify_responses(t.response_lines()).select(
        "article_id", "custom_id", "link_hash", "order_id", "outcome",
        F.when(F.col("outcome") == "ok", F.col("summarization")).alias("summarization"),
        F.when(F.col("outcome") == "ok", shown(F.col("tags"), "t")).alias("tags"),
        F.when(F.col("outcome") == "ok", shown(F.col("key_insights"), "k")).alias("key_insights"),
    )


@case
def outcome_counts(t: Tables) -> DataFrame:
    return responses.outcome_counts(responses.classify_responses(t.response_lines()))


@case
def summary_quality(t: Tables) -> DataFrame:
    return responses.summary_quality(t.full_articles())


@case
def jsonl_roundtrip(t: Tables) -> DataFrame:
    """English documents written, all documents appended twice, the file read back."""
    path = fresh_path(t.spark, "documents") + ".jsonl"
    documents = t.read("documents")
    jsonl.write_jsonl(documents.where("lang = 'en'"), path)
    for _ in range(2):
        jsonl.append_new(documents, path, "doc_id")
    return jsonl.read_jsonl(t.spark, path, documents.schema)


@case
def stream_ingest(t: Tables) -> DataFrame:
    """Response files arriving in two parts, each ingested as it comes."""
    arrived, store_path, progress = (fresh_path(t.spark, n) for n in ("arrived", "store", "progress"))
    lines = t.response_lines()
    is_early = F.col("date") < F.lit(STORED_BEFORE).cast("date")
    for part in (lines.where(is_early), lines):
        part.select("value").write.mode("append").text(arrived)
        ingest_arrivals(
            t.spark, arrived, t.category_rows(), ["line"], store_path, progress, RUN_TIME,
            partial(HashedWords, VECTOR_WIDTH),
        )
    found = search.lookup_articles(open_store(t.spark, store_path), t.lookup_keys())
    return found.where("found").select(
        "link_hash", "link", "headline", "published_date", "summarization",
        F.size("tag_names").cast("bigint").alias("n_tags"),
        F.size("key_insights").cast("bigint").alias("n_insights"),
    )
