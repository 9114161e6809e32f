"""The test tables seen as articles, pages, requests and response lines.

They stand in for what outside models supply (tags, insights, summaries). Whole
tables and whole texts are used; some faults are planted by row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import request_id
from newsloom.runtime import BROADCAST_IDS, fresh_path, prepare, settle, small_if_counted
from newsloom.sources.store import Store, append_run, open_store

# Articles dated before this day count as stored, the others as arriving.
STORED_BEFORE = "2016-01-01"


class Tables:
    """Adapter views over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Articles and their parts

    def entries(self) -> DataFrame:
        """All documents, and an entry without text of its own for every vector beyond them."""
        documents = self.read("documents").select("doc_id", "source", "lang", "text")
        beyond = self.read("embeddings").select(F.col("vec_id").alias("doc_id")).join(documents, "doc_id", "left_anti")
        text = F.concat(F.lit("Entry "), F.col("doc_id").cast("string"), F.lit(" has a vector and no document"))
        return documents.unionByName(
            beyond.select("doc_id", F.lit("vectors").alias("source"), F.lit("en").alias("lang"), text.alias("text"))
        )

    def articles(self) -> DataFrame:
        link = F.concat(F.lit("https://example.com/entry/"), F.col("doc_id").cast("string"))
        days = (F.col("doc_id") * 37 % 4000).cast("int")
        return self.entries().select(
            F.col("doc_id").alias("article_id"),
            link.alias("link"),
            F.md5(link).alias("link_hash"),
            F.concat(F.lit("Entry "), F.col("doc_id").cast("string"), F.lit(" from "), "source").alias("headline"),
            F.date_add(F.lit("2012-01-01").cast("date"), days).alias("date"),
            F.col("lang").alias("category"),
            F.col("text").alias("summarization"),
        )

    @staticmethod
    def tag_list(text: Column) -> Column:
        """Distinct lower-case words of 4 to 12 letters a-z."""
        words = F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]+", " ")), " ")
        return F.array_distinct(F.filter(words, lambda w: F.length(w).between(4, 12)))

    @staticmethod
    def insight_list(text: Column) -> Column:
        """Distinct sentences of more than 20 characters."""
        sentences = F.transform(F.split(text, r"\. "), lambda s: F.trim(s))
        return F.array_distinct(F.filter(sentences, lambda s: F.length(s) > 20))

    def full_articles(self) -> DataFrame:
        """Articles with their tags and insights in lists."""
        return self.articles().select(
            "*",
            self.tag_list(F.col("summarization")).alias("tags"),
            self.insight_list(F.col("summarization")).alias("key_insights"),
        )

    @staticmethod
    def tag_id(tag: Column) -> Column:
        return F.coalesce(F.conv(F.substring(F.md5(tag), 1, 15), 16, 10).cast("bigint"), F.lit(0))

    def article_tag_names(self, articles: DataFrame) -> DataFrame:
        tags = F.explode(self.tag_list(F.col("summarization"))).alias("tag")
        return articles.select("article_id", tags)

    @staticmethod
    def _once(texts: DataFrame) -> DataFrame:
        """Each (article_id, summarization) once; only texts of repeated ids are shuffled."""
        again = texts.groupBy("article_id").count().where("count > 1").select("article_id")
        again = small_if_counted(settle(again, "again"), BROADCAST_IDS)
        repeated = texts.join(again, "article_id", "left_semi").dropDuplicates(["article_id", "summarization"])
        return texts.join(again, "article_id", "left_anti").unionByName(repeated)

    def store(self, articles: DataFrame | None = None, all_summaries: bool = False) -> Store:
        """The five tables. With ``all_summaries`` articles without a vector have an
        embedding row as well, its vector null."""
        articles = self.articles() if articles is None else articles
        pairs = self.article_tag_names(articles)
        tag_id = self.tag_id(F.col("tag")).alias("tag_id")
        insights = articles.select(
            "article_id", F.explode(self.insight_list(F.col("summarization"))).alias("key_insight")
        )
        insight_key = F.concat_ws("|", F.col("article_id").cast("string"), "key_insight")
        vectors = self.read("embeddings").select(F.col("vec_id").alias("article_id"), "embedding")
        # The ids go to the texts first: only texts that have a vector are shuffled.
        known = small_if_counted(vectors.select("article_id").distinct(), BROADCAST_IDS)
        texts = articles.select("article_id", "summarization")
        embedded = texts.join(known, "article_id", "left_semi").join(vectors, "article_id")
        if all_summaries:
            bare = self._once(texts.where("article_id IS NOT NULL").join(known, "article_id", "left_anti"))
            embedded = embedded.unionByName(bare, allowMissingColumns=True)
        return Store(
            articles=articles.select("article_id", "link_hash", "link", "headline", "date"),
            tags=pairs.select("tag").distinct().select(tag_id, "tag"),
            article_tags=pairs.select("article_id", tag_id),
            key_insights=insights.select(
                self.tag_id(insight_key).alias("key_insight_id"), "key_insight", "article_id"
            ),
            embeddings=embedded.select(F.col("article_id").alias("embedding_id"), "summarization", "article_id", "embedding"),
        )

    def written_store(self, articles: DataFrame | None = None, all_summaries: bool = False) -> Store:
        """The store as an upload leaves it: written as one run and opened."""
        stamp = F.lit("2024-01-01").cast("timestamp_ntz")
        rows = self.store(articles, all_summaries)
        stamped = [getattr(rows, n).withColumns({"created_at": stamp, "updated_at": stamp}) for n in Store.names()]
        path = fresh_path(self.spark, "store")
        append_run(Store(*stamped), path, 0)
        return open_store(self.spark, path)

    def stored_articles(self) -> DataFrame:
        return self.articles().where(F.col("date") < F.lit(STORED_BEFORE).cast("date"))

    def stored(self) -> Store:
        return self.store(self.stored_articles())

    # Inputs of the ingest

    def category_rows(self) -> DataFrame:
        """Category file rows; the articles in English are listed a second time."""
        rows = self.articles()
        columns = ["link", "link_hash", "headline", "date"]
        first = rows.select((F.col("article_id") * 2).alias("line"), *columns)
        again = rows.where("category = 'en'").select(
            (F.col("article_id") * 2 + 1).alias("line"),
            "link",
            "link_hash",
            F.concat(F.lit("Again: "), "headline").alias("headline"),
            "date",
        )
        return first.unionByName(again)

    def summary_rows(self) -> DataFrame:
        return self.full_articles().select(
            F.col("article_id").alias("line"), "link_hash", "summarization", "tags", "key_insights"
        )

    def faulty_rows(self) -> DataFrame:
        """Joined rows, most of them with a planted fault."""
        fault = F.col("article_id") % 8

        def planted(number: int, value: Column, name: str) -> Column:
            return F.when(fault == number, value).otherwise(F.col(name)).alias(name)

        long_tag = F.array(F.repeat(F.lit("t"), 256))
        return self.full_articles().select(
            "article_id",
            planted(1, F.concat("link_hash", F.lit("0")), "link_hash"),
            planted(2, F.concat("link", F.repeat(F.lit("/x"), 128)), "link"),
            planted(3, F.lit(None).cast("string"), "headline"),
            planted(4, F.lit(None).cast("date"), "date"),
            "summarization",
            planted(5, F.concat("tags", long_tag), "tags"),
            planted(6, F.concat("key_insights", "key_insights"), "key_insights"),
        )

    # Searches

    def searches(self) -> DataFrame:
        """A search for every vector whose id is divisible by 50, against all rows: the
        vector, and one of three tag lists (frequent tags, tags of several languages, tags
        that no article has)."""
        list_number = F.col("vec_id") % 3
        tags = (
            F.when(list_number == 0, F.lit("that,with,oner"))
            .when(list_number == 1, F.lit("nicht,pour,para"))
            .otherwise(F.lit("hector,achilles"))
        )
        requests = (
            self.read("embeddings")
            .where(F.col("vec_id") % 50 == 0)
            .select(
                F.col("vec_id").cast("bigint").alias("query_id"),
                F.split(tags, ",").alias("tags"),
                F.col("embedding").cast("array<double>").alias("query_vec"),
            )
        )
        return settle(requests, "searches")

    def search_texts(self) -> DataFrame:
        """Raw requests: the source and language of each document as tags, spelled in five ways."""
        spelling = F.col("doc_id") % 5
        names = (
            F.when(spelling == 0, F.concat_ws(",", "source", "lang"))
            .when(spelling == 1, F.concat_ws(", ", "source", "lang"))
            .when(spelling == 2, F.concat_ws(",,", "source", "lang"))
            .when(spelling == 3, F.lit(""))
        )
        return self.read("documents").select(
            F.col("doc_id").alias("query_id"), names.alias("tag_names")
        )

    def lookup_keys(self) -> DataFrame:
        """The keys of all articles, and those of all page links, which no article has."""
        pages = self.read("pages").select(F.md5("url").alias("link_hash"))
        return self.articles().select("link_hash").unionByName(pages)

    # Files between the stages

    def dump(self) -> DataFrame:
        """Raw dump: all documents, at a page's link where there is one; every 7th link doubled."""
        days = (F.col("doc_id") * 37 % 4000).cast("int")
        own = F.concat(F.lit("https://example.com/entry/"), F.col("doc_id").cast("string"))
        at_page = self.read("pages").select(F.col("page_id").alias("doc_id"), "url")
        link = F.coalesce("url", own)
        return (
            self.read("documents")
            .join(at_page, "doc_id", "left")
            .select(
                F.col("lang").alias("category"),
                F.when(F.col("doc_id") % 7 == 0, F.concat(link, link)).otherwise(link).alias("link"),
                F.concat(F.lit("Entry "), F.col("doc_id").cast("string")).alias("headline"),
                F.date_add(F.lit("2012-01-01").cast("date"), days).alias("date"),
            )
        )

    def pages(self) -> DataFrame:
        """Fetched pages; every 9th counts as a failed fetch."""
        html = F.when(F.col("page_id") % 9 == 0, "").otherwise(F.col("html"))
        return self.read("pages").select("page_id", F.col("url").alias("link"), html.alias("html"))

    def contents(self) -> DataFrame:
        """Content rows of all documents, every 11th content empty."""
        link = F.concat(F.lit("https://example.com/entry/"), F.col("doc_id").cast("string"))
        content = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text"))
        return self.read("documents").select(
            "doc_id", link.alias("link"), content.alias("content"), F.md5(link).alias("link_hash")
        )

    def response_lines(self) -> DataFrame:
        """(article_id, value): a response line per article, one of six outcomes."""
        custom_id = request_id(F.col("link_hash"), F.col("article_id") % 50)
        whole = F.to_json(F.struct("summarization", "tags", "key_insights"))
        partial = F.to_json(F.struct("summarization", "key_insights"))
        kind = F.col("article_id") % 6

        def answer(content: Column) -> Column:
            message = F.struct(F.struct(content.alias("content")).alias("message"))
            body = F.struct(F.array(message).alias("choices"))
            return F.to_json(
                F.struct(custom_id.alias("custom_id"), F.struct(body.alias("body")).alias("response"))
            )

        def bare(rest: str) -> Column:
            return F.concat(F.lit('{"custom_id":"'), custom_id, F.lit('"' + rest))

        value = (
            F.when(kind == 0, answer(whole))
            .when(kind == 1, answer(partial))
            .when(kind == 2, bare(',"response":{"body":{"choices":[]}}}'))
            .when(kind == 3, bare(',"error":{"code":"429","message":"too many requests"}}'))
            .when(kind == 4, bare("}"))
            .otherwise(bare(',"response":'))
        )
        return self.full_articles().select("article_id", "date", value.alias("value"))
