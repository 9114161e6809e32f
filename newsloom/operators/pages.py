"""Fetched pages to text."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.html_text import html_to_text
from newsloom.functions.links import link_hash

OK = "ok"
# Fixed value: status of a page that could not be fetched.
NOT_FETCHED = "Failed to fetch"


def page_status(pages: DataFrame) -> DataFrame:
    """Add ``status``: a page without HTML was not fetched."""
    fetched = F.coalesce(F.col("html"), F.lit("")) != ""
    return pages.withColumn("status", F.when(fetched, OK).otherwise(NOT_FETCHED))


def page_text(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``content``; every page stays, with a status.

    Pages keep their partitions. A page that breaks the parser gets the error as status.
    """
    kept = [c for c in pages.columns if c not in ("html", "status")]
    columns = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents, states = [], []
            for html, status in zip(batch["html"], batch["status"]):
                content = None
                if status == OK:
                    try:
                        content = html_to_text(html)
                    except Exception as error:  # noqa: BLE001 - any fault of one page
                        status = f"Parsing failed: {error}"
                contents.append(content)
                states.append(status)
            yield batch[kept].assign(content=contents, status=states)

    with_status = page_status(pages).select(*kept, "html", "status")
    return with_status.mapInPandas(convert, f"{columns}, content string, status string")


def content_rows(pages: DataFrame) -> DataFrame:
    """Rows of the content file: (link, content, link_hash, status)."""
    return page_text(pages.select("link", "html")).select(
        "link", "content", link_hash("link").alias("link_hash"), "status"
    )
