"""The five stored tables as Parquet folders, one subfolder per run.

A run adds rows, new versions of stored rows (same natural key) or tombstones of
stored rows; one tombstone of an article stands for its rows in every table. Readers resolve the newest version of every key that a change run
touched: only the rows of change runs and the tombstones are shuffled, the rows of
plain runs stream through a join with those keys. A compaction writes the resolved
tables as a base run; readers start from the newest complete base.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.runtime import BROADCAST_IDS, BROADCAST_ROWS, PACKED, small_if_counted

# Natural keys of the stored tables: a newer version of a row has the same key.
KEYS = {
    "articles": ["article_id"],
    "tags": ["tag_id"],
    "article_tags": ["article_id", "tag_id"],
    "key_insights": ["key_insight_id"],
    "embeddings": ["embedding_id"],
}


@dataclass
class Store:
    articles: DataFrame
    tags: DataFrame
    article_tags: DataFrame
    key_insights: DataFrame
    embeddings: DataFrame

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]


def empty_store(spark: SparkSession) -> Store:
    return Store(*[spark.createDataFrame([], schemas.STORE[name]) for name in Store.names()])


def _marker(spark: SparkSession, path: str, run: str, kind: str = "complete"):
    """File system and path of a mark of a run: complete, changes (versions or
    tombstones inside) or base (a compaction)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/run={run}")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _marked(spark: SparkSession, path: str, kind: str) -> list[int]:
    files, pattern = _marker(spark, path, "*", kind)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in files.globStatus(pattern) or [])


def complete_runs(spark: SparkSession, path: str) -> list[int]:
    return _marked(spark, path, "complete")


def readable_runs(spark: SparkSession, path: str, before_run: int | None = None) -> list[int]:
    """Complete runs (before ``before_run``) from the newest complete base on."""
    runs = [r for r in complete_runs(spark, path) if before_run is None or r < before_run]
    bases = [r for r in _marked(spark, path, "base") if r in runs]
    return [r for r in runs if not bases or r >= max(bases)]


def _columns(fields) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def _newest(spark: SparkSession, rows: DataFrame, path: str, name: str, changed: list[int]) -> DataFrame:
    """The rows whose key has no newer version and no tombstone at their run or later.

    A tombstone and a version of one key in one run: the tombstone wins.
    """
    keys = KEYS[name]
    fields = [schemas.STORE[name][k] for k in keys]
    versions = rows.where(F.col("run").isin(changed)).select(*keys, "run", F.lit(False).alias("dead"))
    dead = (
        spark.read.schema(f"{_columns(fields)}, run bigint")
        .option("basePath", f"{path}/deleted/{name}")
        .parquet(*[f"{path}/deleted/{name}/run={r}" for r in changed])
        .select(*keys, "run", F.lit(True).alias("dead"))
    )
    newest = versions.unionByName(dead).groupBy(*keys).agg(F.max(F.struct("run", "dead")).alias("_newest"))
    newest = small_if_counted(newest, BROADCAST_ROWS)
    last = F.col("_newest")
    alive = last.isNull() | (F.col("run") > last["run"]) | ((F.col("run") == last["run"]) & ~last["dead"])
    return rows.join(newest, keys, "left").where(alive).drop("_newest")


def _of_living_articles(spark: SparkSession, rows: DataFrame, path: str, gone: list[int]) -> DataFrame:
    """The rows whose article has no tombstone at their run or later. Only the ids of
    deleted articles are held against the rows, which stay where they are."""
    dead = (
        spark.read.schema("article_id bigint, run bigint")
        .option("basePath", f"{path}/cascade")
        .parquet(*[f"{path}/cascade/run={r}" for r in gone])
        .groupBy("article_id")
        .agg(F.max("run").alias("_gone"))
    )
    dead = small_if_counted(dead, BROADCAST_IDS)
    return rows.join(dead, "article_id", "left").where("_gone IS NULL OR run > _gone").drop("_gone")


def open_store(spark: SparkSession, path: str, before_run: int | None = None) -> Store:
    """Read the completely written runs, optionally only those before a run, each key
    in its newest version and without the deleted ones."""
    runs = readable_runs(spark, path, before_run)
    if not runs:
        return empty_store(spark)
    changed = [r for r in _marked(spark, path, "changes") if r in runs]
    gone = [r for r in _marked(spark, path, "cascade") if r in runs]
    tables = []
    for name in Store.names():
        rows = spark.read.schema(f"{_columns(schemas.STORE[name])}, run bigint").parquet(f"{path}/{name}")
        rows = rows.where(F.col("run").isin(runs))
        if changed:
            rows = _newest(spark, rows, path, name, changed)
        if gone and "article_id" in rows.columns:
            rows = _of_living_articles(spark, rows, path, gone)
        tables.append(rows.select(*schemas.STORE[name].names))
    return Store(*tables)


def append_run(
    rows: Store, path: str, run: int, deleted: dict[str, DataFrame] | None = None, changes: bool = False, gone: DataFrame | None = None
) -> None:
    """Write the rows of one run. A repeated run replaces what it wrote before; a run
    that breaks off is not marked complete and readers pass over it.

    ``changes`` says that rows may be new versions of stored keys; ``deleted`` gives
    tombstones (the key columns) per table. Either makes the run a change run. ``gone``
    gives deleted articles (``article_id``): their rows of this run and before, in all tables.
    """
    spark = rows.articles.sparkSession
    files, mark = _marker(spark, path, str(run))
    files.delete(mark, False)
    files.delete(_marker(spark, path, str(run), "cascade")[1], True)
    for name in Store.names():
        table = getattr(rows, name).select(*schemas.STORE[name].names)
        table.write.mode("overwrite").parquet(f"{path}/{name}/run={run}", compression=PACKED)
    if changes or deleted:
        for name in Store.names():
            keys = (deleted or {}).get(name)
            keys = spark.createDataFrame([], schemas.STORE[name]) if keys is None else keys
            keys.select(*KEYS[name]).write.mode("overwrite").parquet(f"{path}/deleted/{name}/run={run}")
        files.create(_marker(spark, path, str(run), "changes")[1], True).close()
    if gone is not None:
        gone.select("article_id").write.mode("overwrite").parquet(f"{path}/cascade/run={run}")
    files.create(mark, True).close()


def compact(spark: SparkSession, path: str, run: int, remove: bool = False) -> None:
    """Write the resolved tables as base run ``run`` (above all complete runs); readers
    then start there. With ``remove`` the folded runs' folders go once the base is complete,
    which readers that opened the store before must not outlive."""
    folded = readable_runs(spark, path)
    if folded and run <= max(complete_runs(spark, path)):
        raise ValueError(f"run {run} must be above the newest complete run of {path}")
    store = open_store(spark, path)
    files, mark = _marker(spark, path, str(run))
    files.delete(mark, False)
    for name in Store.names():
        getattr(store, name).write.mode("overwrite").parquet(f"{path}/{name}/run={run}", compression=PACKED)
    files.create(_marker(spark, path, str(run), "base")[1], True).close()
    files.create(mark, True).close()
    if remove:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for r in folded:
            for name in Store.names():
                files.delete(hadoop(f"{path}/{name}/run={r}"), True)
                files.delete(hadoop(f"{path}/deleted/{name}/run={r}"), True)
            files.delete(hadoop(f"{path}/cascade/run={r}"), True)
