"""Answers of the summarizer: classification of every line, summaries, quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.json_text import whole_object
from newsloom.functions.text import request_id_hash, request_id_number, strip_whitespace

OK = "ok"
UNDECODABLE = "undecodable"
MALFORMED_ID = "malformed_id"
INVALID_SUMMARY = "invalid_summary"
NO_CHOICES = "no_choices"
API_ERROR = "api_error"
UNEXPECTED = "unexpected"

_LINE = "custom_id variant, response struct<body variant>, error variant, seal string"
_SUMMARY = "summarization variant, tags variant, key_insights variant, seal string"


def _type(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _texts(value: Column) -> Column:
    """A JSON list of texts as array, null for anything else."""
    items = F.try_variant_get(value, "$", "array<string>")
    listed = _type(value).isin("ARRAY<STRING>", "ARRAY<VOID>")
    return F.when(listed & F.forall(items, lambda x: x.isNotNull()), items)


def _text(value: Column) -> Column:
    return F.when(_type(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _present(value: Column) -> Column:
    """Neither missing nor one of the empty JSON values."""
    shown = F.coalesce(F.to_json(value), F.lit("null"))
    return ~shown.isin("null", "{}", "[]", '""', "0", "0.0", "false")


def classify_responses(lines: DataFrame) -> DataFrame:
    """Parse the ``value`` column and add the outcome; every line stays.

    Columns added: custom_id, link_hash, order_id, summarization, tags, key_insights, outcome.
    """
    result = lines.withColumn("_line", whole_object(F.col("value"), _LINE))
    custom_id = F.coalesce(_text(F.col("_line.custom_id")), F.lit("N/A"))
    body = F.col("_line.response.body")
    result = result.select(
        "*",
        F.when(F.col("_line").isNotNull(), custom_id).alias("custom_id"),
        F.try_variant_get(body, "$.choices[0]", "variant").isNotNull().alias("_has_choice"),
        strip_whitespace(_text(F.try_variant_get(body, "$.choices[0].message.content", "variant"))).alias(
            "_content"
        ),
    ).withColumn("_summary", whole_object(F.col("_content"), _SUMMARY))
    result = result.select(
        "*",
        request_id_hash(F.col("custom_id")).alias("link_hash"),
        request_id_number(F.col("custom_id")).alias("order_id"),
        _text(F.col("_summary.summarization")).alias("summarization"),
        _texts(F.col("_summary.tags")).alias("tags"),
        _texts(F.col("_summary.key_insights")).alias("key_insights"),
    )
    complete = (
        F.col("summarization").isNotNull()
        & F.col("tags").isNotNull()
        & F.col("key_insights").isNotNull()
    )
    has_choice = F.col("_has_choice")
    outcome = (
        F.when(F.col("_line").isNull(), UNDECODABLE)
        .when(F.col("link_hash").isNull(), MALFORMED_ID)
        .when(has_choice & complete, OK)
        .when(has_choice, INVALID_SUMMARY)
        .when(_present(body), NO_CHOICES)
        .when(_present(F.col("_line.error")), API_ERROR)
        .otherwise(UNEXPECTED)
    )
    return result.withColumn("outcome", outcome).drop("_line", "_has_choice", "_content", "_summary")


def summaries(classified: DataFrame, *more: str) -> DataFrame:
    """Rows of the summary file, with more columns of the lines if wanted."""
    return classified.where(F.col("outcome") == OK).select(
        "tags", "key_insights", "link_hash", "order_id", "custom_id", "summarization", *more
    )


def quarantined(classified: DataFrame) -> DataFrame:
    """Every line that gave no summary, with its outcome."""
    return classified.where(F.col("outcome") != OK).select("custom_id", "outcome", "value")


def outcome_counts(classified: DataFrame) -> DataFrame:
    """Lines per outcome."""
    return classified.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_lines"))


def quality_rules() -> dict[str, Column]:
    """Rules a good summary keeps; a report, nothing is rejected by them."""
    words = F.size(F.regexp_extract_all("summarization", F.lit(r"\S+"), F.lit(0)))
    return {
        "tags_3_to_10": F.size("tags").between(3, 10),
        "tags_lower_case": F.forall("tags", lambda t: t == F.lower(t)),
        "tags_without_blanks": F.forall("tags", lambda t: ~t.rlike(r"[^\p{L}\p{N}-]")),
        "tags_1_to_3_words": F.forall("tags", lambda t: F.size(F.split(t, "[ -]")) <= 3),
        "insights_3_to_10": F.size("key_insights").between(3, 10),
        "insights_start_capital": F.forall("key_insights", lambda k: k.rlike(r"\A\p{Lu}")),
        "insights_end_full_stop": F.forall("key_insights", lambda k: k.endswith(".")),
        "words_100_to_500": words.between(100, 500),
    }


def summary_quality(rows: DataFrame) -> DataFrame:
    """(rule, n_kept, n_broken) over all summaries, in one pass."""
    rules = quality_rules()
    kept = rows.select(*[rule.alias(name) for name, rule in rules.items()]).agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col(name)).alias(name) for name in rules],
    )
    return kept.unpivot("_all", list(rules), "rule", "n_kept").select(
        "rule", "n_kept", (F.col("_all") - F.col("n_kept")).alias("n_broken")
    )
