"""What the operators share: bounded text batches, places inside groups, components of a graph."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import settle

# Bytes of text that a task holds as Python values at once.
BATCH_BYTES = 4 << 20


def give_back() -> None:
    """Return freed memory to the system.

    A worker serves many tasks and stages; what one of them needed for a moment would
    stay with it while the next ones need theirs.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``limit`` bytes, or list items, in each.

    A longer row stands alone. Memory is given back before the first and after the last.
    """
    import pyarrow.compute as pc

    give_back()
    for batch in batches:
        values = batch.column(column)
        lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of splitmix64, fixed values)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class RollingHash:
    """64-bit hashes of any stretches of a buffer, from running sums of its bytes."""

    def __init__(self) -> None:
        self.codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        base = 0x5851F42D4C957F2D
        self.steps = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def read(self, buffer: np.ndarray) -> None:
        size = len(buffer) + 1
        if len(self.up) < size:
            powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, s)]), dtype=np.uint64) for s in self.steps]
            self.up, self.down = powers
        terms = self.codes[buffer] * self.down[: len(buffer)]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from ``starts`` to ``ends`` of the buffer last read."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.up[starts] + (ends - starts).astype(np.uint64))


def arrow_rows(schema: str):
    """The Arrow schema of a DDL string, and the string itself for ``mapInArrow``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def place_within(
    rows: DataFrame, groups: list[str], order: list[str], name: str, rows_per_bucket: int = 100_000
) -> DataFrame:
    """Number the rows of each group from 0 without sorting a whole group in one task.

    Rows are dealt by a hash of ``order`` into buckets; a row's number is its place
    in the bucket plus the sizes of the group's earlier buckets. Rows that agree in
    all of ``order`` are told apart at random, so give enough columns.
    """
    session = rows.sparkSession
    buckets = max(rows.count() // rows_per_bucket + 1, session.sparkContext.defaultParallelism)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*groups, "_bucket"]
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        dealt.withColumn("_inside", F.row_number().over(inside))
        .join(starts, keys)
        .withColumn(name, F.col("_start") + F.col("_inside") - 1)
        .drop("_start", "_inside", "_bucket")
    )


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from every node that has a link: ``node, component``.

    ``links`` has two long columns ``a, b``. Large-star and small-star steps in turn,
    each written to the shared folder, until every node points at its smallest. A node
    of many links costs rows of a shuffle that adaptive execution can split, never a list.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = settle(small.select("e.*").where("u <> v").distinct(), "small-star")
        # Done when every node points at one other, and none that is pointed at points on.
        ends = edges.select("u", F.lit(1).alias("out")).union(edges.select("v", F.lit(0)).distinct())
        ends = ends.groupBy("u").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("rows"))
        if ends.where("out > 1 OR (out = 1 AND rows > 1)").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
