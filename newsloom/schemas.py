"""Schemas of the stored tables, the files between stages and the result rows."""

from pyspark.sql import types as T

_STAMPS = [
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
]

ARTICLES = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("link_hash", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("headline", T.StringType()),
        T.StructField("date", T.DateType()),
        *_STAMPS,
    ]
)
TAGS = T.StructType(
    [T.StructField("tag_id", T.LongType()), T.StructField("tag", T.StringType()), *_STAMPS]
)
ARTICLE_TAGS = T.StructType(
    [T.StructField("article_id", T.LongType()), T.StructField("tag_id", T.LongType()), *_STAMPS]
)
KEY_INSIGHTS = T.StructType(
    [
        T.StructField("key_insight_id", T.LongType()),
        T.StructField("key_insight", T.StringType()),
        T.StructField("article_id", T.LongType()),
        *_STAMPS,
    ]
)
EMBEDDINGS = T.StructType(
    [
        T.StructField("embedding_id", T.LongType()),
        T.StructField("summarization", T.StringType()),
        T.StructField("article_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        *_STAMPS,
    ]
)
STORE = {
    "articles": ARTICLES,
    "tags": TAGS,
    "article_tags": ARTICLE_TAGS,
    "key_insights": KEY_INSIGHTS,
    "embeddings": EMBEDDINGS,
}

RAW_DUMP = "category string, link string, headline string, date date"
CATEGORY_FILE = "link string, headline string, date date, link_hash string"
CONTENT_FILE = "link string, content string, link_hash string, status string"
SUMMARY_FILE = (
    "tags array<string>, key_insights array<string>, link_hash string, "
    "order_id string, custom_id string, summarization string"
)
REQUEST_FILE = (
    "custom_id string, method string, url string, "
    "body struct<model string, messages array<struct<role string, content string>>, "
    "temperature double, response_format struct<type string>>"
)

# Column widths of the stored tables, in characters.
MAX_LINK_HASH = 32
MAX_LINK = 255
MAX_HEADLINE = 255
MAX_TAG = 255
MAX_KEY_INSIGHT = 1000
