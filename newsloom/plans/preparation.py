"""The file-to-file stages: extract, page text, request chunks, summary file."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from newsloom import schemas
from newsloom.operators import extract, pages, requests, responses
from newsloom.runtime import settle
from newsloom.sources import jsonl


def extract_category(
    spark: SparkSession,
    dump: str,
    output: str,
    category: str = extract.CATEGORY,
    first_day: date = extract.FIRST_DAY,
    rejected: str | None = None,
) -> None:
    """Raw dump to category file. Lines that are no object, or whose date is no day, go
    with their reason to ``rejected``, by default beside the output."""
    rows = jsonl.checked_lines(spark, dump, schemas.RAW_DUMP, ("date",))
    sound = rows.where("reason IS NULL")
    jsonl.write_jsonl(extract.with_link_hash(extract.select_category(sound, category, first_day)), output)
    beside = rejected or output.rstrip("/").removesuffix(jsonl.SUFFIX) + ".rejected" + jsonl.SUFFIX
    jsonl.write_jsonl(rows.where("reason IS NOT NULL").select("value", "reason"), beside)


def texts_of_pages(fetched: DataFrame, links: DataFrame, output: str) -> None:
    """Text of the fetched pages (link, html) of the given links; a link without a
    fetched page is a failed fetch. A rerun adds only links not in the output."""
    wanted = links.select("link").join(fetched.select("link", "html"), "link", "left")
    jsonl.append_new(pages.content_rows(wanted), output)


def prepare_requests(
    spark: SparkSession,
    content: str,
    output: str,
    rejected: str,
    template: requests.RequestTemplate | None = None,
) -> DataFrame:
    """Content file to one request file per chunk; refused lines go to ``rejected``.
    Returns the rows per reason."""
    judged = requests.judge_lines(jsonl.content_lines(jsonl.read_lines(spark, content)))
    numbered = requests.requests_from_lines(judged)
    jsonl.write_chunks(requests.request_lines(numbered, template), output, grouped=True)
    jsonl.write_jsonl(requests.rejected_lines(judged), rejected)
    return requests.request_counts(judged)


def parse_responses(spark: SparkSession, responses_dir: str, output: str, rejected: str) -> DataFrame:
    """Folder of response files to summary file; returns the lines per outcome."""
    classified = settle(responses.classify_responses(jsonl.read_lines(spark, responses_dir)), "classified")
    jsonl.write_jsonl(responses.summaries(classified), output)
    jsonl.write_jsonl(responses.quarantined(classified), rejected)
    return responses.outcome_counts(classified)
