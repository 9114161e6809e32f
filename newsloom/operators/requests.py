"""Numbered summary requests in chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import filled, request_id
from newsloom.operators.numbering import number_rows, range_bucket
from newsloom.sources.jsonl import PLACES

# Lines per chunk and the least content length in characters.
CHUNK_LINES = 50
MIN_CONTENT = 100

UNDECODABLE, MALFORMED, SHORT = "undecodable", "malformed", "short"


@dataclass(frozen=True)
class RequestTemplate:
    """What a request says besides the text. The first five are fixed values of the format."""

    method: str = "POST"
    url: str = "/v1/chat/completions"
    user_prefix: str = "Summarize the following web article content:\n\n"
    temperature: float = 0.3
    response_type: str = "json_object"
    model: str = "gpt-4.1-mini"
    system: str = (
        "Summarize the article. Answer with one JSON object holding summarization (text), "
        "tags (list of texts) and key_insights (list of texts)."
    )

    def body(self, content: Column) -> Column:
        def message(role: str, text: Column) -> Column:
            return F.struct(F.lit(role).alias("role"), text.alias("content"))

        return F.struct(
            F.lit(self.model).alias("model"),
            F.array(
                message("system", F.lit(self.system)),
                message("user", F.concat(F.lit(self.user_prefix), content)),
            ).alias("messages"),
            F.lit(self.temperature).alias("temperature"),
            F.struct(F.lit(self.response_type).alias("type")).alias("response_format"),
        )


def rejection(decodable: Column | None = None) -> Column:
    """Why a row becomes no request; null when it does."""
    reason = F.when(~filled("link", "content", "link_hash"), MALFORMED).when(
        F.length("content") < MIN_CONTENT, SHORT
    )
    return reason if decodable is None else F.when(~decodable, UNDECODABLE).otherwise(reason)


def number_requests(indexed: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Add chunk and request numbers to rows that carry ``row_index`` and ``reason``.

    Every input line counts for the chunk, only accepted ones for the request number.
    """
    accepted = F.col("reason").isNull()
    so_far = (
        Window.partitionBy("chunk_number")
        .orderBy("row_index")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    number = F.count(F.when(accepted, 1)).over(so_far) - 1
    return (
        indexed.withColumn("chunk_number", F.expr(f"row_index div {chunk_lines}"))
        .withColumn("request_number", F.when(accepted, number))
        .withColumn(
            "custom_id", F.when(accepted, request_id(F.col("link_hash"), F.col("request_number")))
        )
    )


def requests_from_table(
    rows: DataFrame,
    order: str,
    rows_per_bucket: int = 200_000,
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """Number the rows of a table by its unique numeric column ``order``."""
    bucketed = range_bucket(rows.withColumn("reason", rejection()), order, rows_per_bucket)
    indexed = number_rows(bucketed, ["bucket"], [order]).drop("bucket")
    return number_requests(indexed, chunk_lines)


def judge_lines(lines: DataFrame) -> DataFrame:
    """Add ``reason`` to content lines (see ``content_lines``)."""
    return lines.withColumn("reason", rejection(F.col("decodable")))


def requests_from_lines(judged: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Number judged lines in file order. Only what a request needs is shuffled."""
    content = F.when(F.col("reason").isNull(), F.col("content")).alias("content")
    needed = judged.select(*PLACES, "link", content, "link_hash", "reason")
    indexed = number_rows(needed, PLACES[:-1], PLACES[-1:])
    return number_requests(indexed.drop(*PLACES), chunk_lines)


def request_lines(numbered: DataFrame, template: RequestTemplate | None = None) -> DataFrame:
    """(chunk_number, request_number, value): the request as one line of JSON."""
    template = template or RequestTemplate()
    line = F.to_json(
        F.struct(
            "custom_id",
            F.lit(template.method).alias("method"),
            F.lit(template.url).alias("url"),
            template.body(F.col("content")).alias("body"),
        )
    )
    return numbered.where("reason IS NULL").select(
        "chunk_number", "request_number", line.alias("value")
    )


def rejected_lines(judged: DataFrame) -> DataFrame:
    """The quarantine: lines that become no request, with the reason."""
    return judged.where("reason IS NOT NULL").select("value", "reason", "file_path")


def request_counts(judged: DataFrame) -> DataFrame:
    """Rows per reason, ``prepared`` for those that become requests."""
    outcome = F.coalesce("reason", F.lit("prepared")).alias("outcome")
    return judged.groupBy(outcome).agg(F.count(F.lit(1)).alias("n_rows"))
