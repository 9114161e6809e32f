"""JSON-lines files: scans that survive bad lines, and the writers between stages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.json_text import whole_object

SUFFIX = ".jsonl"
# Columns that give the order of the input without sorting it: the last one grows
# along a block of a file.
PLACES = ["file_path", "block_start", "line_order"]


def check_name(path: str) -> str:
    if not path.rstrip("/").endswith(SUFFIX):
        raise ValueError(f"name must end with {SUFFIX}: {path}")
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Scan with a declared schema: no inference pass."""
    return spark.read.schema(schema).json(path)


def checked_lines(spark: SparkSession, path: str, fields: str, dates: tuple[str, ...] = ()) -> DataFrame:
    """Lines with their place, their ``fields``, and why a line cannot be read, else null.

    A line must be one JSON object; the named date fields are read as text and must be
    null or days. Nothing is dropped here.
    """
    lines = placed(spark.read.text(path))
    kinds = dict(f.split(" ", 1) for f in re.split(r",\s*(?![^<]*>)", fields))
    text = ", ".join(f"`{n}` {'string' if n in dates else k}" for n, k in kinds.items())
    parsed = lines.withColumn("_parsed", whole_object(F.col("value"), f"{text}, seal string"))
    read = lambda n: F.col(f"_parsed.{n}").try_cast("date") if n in dates else F.col(f"_parsed.{n}")
    reason = F.when(F.col("_parsed").isNull(), "undecodable")
    for name in dates:
        reason = reason.when(F.col(f"_parsed.{name}").isNotNull() & read(name).isNull(), f"{name}_unreadable")
    return parsed.select("value", *PLACES, *[read(n).alias(n) for n in kinds], reason.alias("reason"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with their place in the input, see ``PLACES``."""
    return rows.select(
        *rows.columns,
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_order"),
    )


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """The links of a category file. The name is checked as the reader of links asks for."""
    check_name(path)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_jsonl(spark, path, "link string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their place."""
    return placed(spark.read.text(path))


def content_lines(lines: DataFrame) -> DataFrame:
    """Fields of content-file lines; a line that is no JSON object stays, not decodable."""
    parsed = whole_object(F.col("value"), f"{schemas.CONTENT_FILE}, seal string")
    return lines.withColumn("_parsed", parsed).select(
        *lines.columns,
        "_parsed.link",
        "_parsed.content",
        "_parsed.link_hash",
        F.col("_parsed").isNotNull().alias("decodable"),
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace the file."""
    df.write.mode("overwrite").json(check_name(path))


def append_new(df: DataFrame, path: str, key: str = "link_hash") -> None:
    """Append the rows whose key the file does not hold yet, so that a rerun adds nothing."""
    spark = df.sparkSession
    if exists(spark, check_name(path)):
        field = df.schema[key]
        stored = spark.read.schema(f"`{key}` {field.dataType.simpleString()}").json(path)
        # Null-safe: a row without a key is appended once, not with every rerun.
        same = F.col(key).eqNullSafe(F.col("_stored"))
        df = df.join(stored.withColumnRenamed(key, "_stored").distinct(), same, "left_anti")
    df.write.mode("append").json(path)


def write_chunks(lines: DataFrame, path: str, grouped: bool = False) -> None:
    """One file per chunk of requests, in request order; a rerun replaces them all.

    ``grouped`` says that a chunk's rows are in one partition already, as they are
    when their numbers were just computed; that saves a shuffle of the texts.
    """
    rows = lines if grouped else lines.repartition("chunk_number")
    rows.sortWithinPartitions("chunk_number", "request_number").select(
        "chunk_number", "value"
    ).write.mode("overwrite").partitionBy("chunk_number").text(path)
