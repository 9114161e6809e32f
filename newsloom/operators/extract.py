"""Selection of one category from the raw dump."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.links import is_corrupted, link_hash

# The category taken and the first day taken.
CATEGORY = "SCIENCE"
FIRST_DAY = date(2015, 1, 1)


def select_category(
    dump: DataFrame, category: str = CATEGORY, first_day: date = FIRST_DAY
) -> DataFrame:
    """(link, headline, date) of sound links in the category, ``date`` as yyyy-MM-dd text."""
    return dump.where(
        (F.col("category") == category)
        & ~is_corrupted(F.col("link"))
        & (F.col("date") >= F.lit(first_day))
    ).select("link", "headline", F.date_format("date", "yyyy-MM-dd").alias("date"))


def with_link_hash(links: DataFrame) -> DataFrame:
    return links.withColumn("link_hash", link_hash("link"))
