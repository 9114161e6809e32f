"""Gap-free numbers over a whole table without a window over the whole table."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def range_bucket(
    df: DataFrame, column: str, rows_per_bucket: int = 200_000, name: str = "bucket"
) -> DataFrame:
    """Add the number of an order-preserving range of ``column``, ranges of about equal size.

    The limits come from quantiles of the column and are literals in the plan, so
    every evaluation, retried tasks included, puts a row into the same bucket.
    """
    total = df.count()
    wanted = max(
        total // rows_per_bucket + 1,
        min(df.sparkSession.sparkContext.defaultParallelism, total // 1000 + 1),
    )
    buckets = max(wanted, 2)
    shares = [i / buckets for i in range(1, buckets)]
    limits = sorted(set(df.approxQuantile(column, shares, 1 / (4 * buckets)))) or [0.0]
    splits = [float("-inf"), *limits, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=column, outputCol=name).transform(df)
    return ranged.withColumn(name, F.col(name).cast("int"))


def hash_digits(hex_key: Column, rows: int, rows_per_bucket: int = 100_000) -> Column:
    """The first digits of a hex hash: as many as keep a bucket at about ``rows_per_bucket``,
    three at least."""
    digits = 3
    while 16**digits * rows_per_bucket < rows:
        digits += 1
    return F.substring(hex_key, 1, digits)


def hash_bucket(
    df: DataFrame, hex_key: Column, rows: int, rows_per_bucket: int = 100_000, name: str = "bucket"
) -> DataFrame:
    """Bucket by the first digits of a hex hash, even buckets in hash order."""
    return df.withColumn(name, hash_digits(hex_key, rows, rows_per_bucket))


def number_rows(
    df: DataFrame, buckets: list[str], order: list[str], name: str = "row_index", sized: DataFrame | None = None
) -> DataFrame:
    """Number the rows from 0 in the order of ``buckets`` and then ``order``.

    Rows are sorted inside their bucket only. The one window without partitions
    runs over the bucket sizes, never over the rows. ``sized`` holds the same rows where
    they can be counted before ``df`` shuffles them.
    """
    sizes = (df if sized is None else sized).groupBy(*buckets).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *buckets, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*buckets).orderBy(*order)
    return (
        df.withColumn("_inside", F.row_number().over(inside))
        .join(starts, buckets)
        .withColumn(name, F.col("_start") + F.col("_inside") - 1)
        .drop("_start", "_inside")
    )
