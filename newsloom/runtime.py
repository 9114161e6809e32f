"""Session helpers: shared work folders, materialised steps, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import newsloom
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of ids or tags (at most 255 characters each) that may be broadcast: well
# under 100 MB even when every row has the full width.
BROADCAST_ROWS = 200_000
# Bytes of texts or vectors that may be broadcast, as the sum over the rows.
BROADCAST_BYTES = 100_000_000
# Bare bigint ids that may be broadcast, alone or in pairs: below 200 MB as a hash table.
BROADCAST_IDS = 4_000_000
# Bigint ids with a link hash each (32 characters) that may be broadcast: some 300 MB as a hash table.
BROADCAST_KEYS = 3_500_000
# Vectors that may be broadcast: about 100 MB at 1536 doubles each.
BROADCAST_VECTORS = 8_000
# Bytes of rows that Spark hands a worker at once, at most; by default 10,000 rows of any length.
HANDED_BYTES = 4 << 20
# How texts are written: a third smaller than by Spark's own choice.
PACKED = "zstd"

_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers run this package without having it installed, and bound the batches
    they get by bytes: a batch is held on both sides. A bound that the session has set stays."""
    cloudpickle.register_pickle_by_value(newsloom)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(HANDED_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local sessions."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="newsloom-")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/newsloom/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, folders: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write a step as a table and read it back.

    Later plans may use it several times without running the step again, and a
    lost executor costs a re-read instead of the whole lineage. ``folders`` names
    columns that get a folder per value, ``codec`` how it is compressed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.partitionBy(*(folders or [])).parquet(path, compression=codec)
    in_scope(path)
    return spark.read.schema(df.schema).parquet(path)


def in_scope(path: str) -> str:
    """Let the surrounding ``scratch``, if there is one, delete the folder when it ends."""
    paths = _scope.get()
    if paths is not None:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was settled inside; results must be written before that."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose row count is known to be within the limit."""
    return F.broadcast(df) if rows <= limit else df


def small_if_counted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint after counting the side; a larger one joins by shuffle."""
    return small(df, df.count(), limit)


def dealt(df: DataFrame, rows: int, rows_per_task: int, *keys) -> DataFrame:
    """Shuffle by ``keys`` into as many tasks as hold ``rows_per_task`` rows each: what a task
    sorts fits its memory, also where the session asks for few partitions."""
    tasks = -(-rows // rows_per_task)
    few = tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(*keys) if few else df.repartition(tasks, *keys)
