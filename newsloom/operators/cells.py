"""Approximate nearest neighbours: vectors grouped into cells, few cells searched."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.vectors import norm
from newsloom.operators.nearest import in_passes, request_blocks
from newsloom.runtime import fresh_path, in_scope


@dataclass
class CellIndex:
    """Cell centres, and the vectors stored in one folder per cell.

    Vectors that have no direction are in cell -1, which every search visits.
    """

    centres: np.ndarray
    vectors: DataFrame


def find_centres(embeddings: DataFrame, cells: int, seed: int = 0) -> np.ndarray:
    """Centres of all vectors that have a direction, by cosine k-means."""
    features = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    usable = embeddings.where(_has_direction()).select(features)
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", predictionCol="cell").fit(usable)
    return np.array(model.clusterCenters())


def _has_direction():
    return F.coalesce(norm(F.col("embedding")) > 0, F.lit(False))


def build_cells(embeddings: DataFrame, cells: int, seed: int = 0) -> CellIndex:
    """Find centres and store every vector under its cell."""
    return place_in_cells(embeddings, find_centres(embeddings, cells, seed))


def place_in_cells(embeddings: DataFrame, centres: np.ndarray) -> CellIndex:
    """Store every vector under the centre nearest in direction, the first one on a tie."""
    spark = embeddings.sparkSession
    vectors = embeddings.select("article_id", "embedding")

    @F.pandas_udf("int")
    def nearest_cell(column: pd.Series) -> pd.Series:
        rows = np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, centres.shape[1]))
        units = centres / np.sqrt((centres * centres).sum(axis=1))[:, None]
        return pd.Series(np.argmax(rows @ units.T, axis=1).astype(np.int32))

    placed = vectors.where(_has_direction()).withColumn("cell", nearest_cell("embedding"))
    rest = vectors.where(~_has_direction()).withColumn("cell", F.lit(-1))
    path = in_scope(fresh_path(spark, "cells"))
    # Rebalancing splits a cell that holds much more than its share.
    placed.unionByName(rest).hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    schema = "article_id bigint, embedding array<float>, cell int"
    return CellIndex(centres, spark.read.schema(schema).parquet(path))


def _probes(queries: np.ndarray, centres: np.ndarray, nprobe: int) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        units = centres / np.sqrt((centres * centres).sum(axis=1))[:, None]
        closeness = np.nan_to_num(queries @ units.T, nan=-np.inf)
    chosen = np.argsort(-closeness, axis=1, kind="stable")[:, :nprobe]
    probes = np.zeros(closeness.shape, dtype=bool)
    np.put_along_axis(probes, chosen, True, axis=1)
    return probes


def nearest_in_cells(index: CellIndex, requests: DataFrame, k: int, nprobe: int) -> DataFrame:
    """The ``k`` nearest among the vectors in each request's ``nprobe`` nearest cells."""

    def visited(block) -> DataFrame:
        chosen = [-1, *np.flatnonzero(block[2].any(axis=0)).tolist()]
        return index.vectors.where(F.col("cell").isin(chosen)).select("article_id", "embedding", "cell")

    blocks = (
        (ids, queries, _probes(queries, index.centres, nprobe))
        for ids, queries in (request_blocks(requests) if k > 0 else ())
    )
    return in_passes(index.vectors.sparkSession, blocks, visited, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per request: exact neighbours, and how many of them the cell search found."""
    keys = ["query_id", "article_id"]
    hits = exact.select(*keys).join(
        found.select(*keys, F.lit(1).alias("hit")), keys, "left"
    )
    return hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")
    )


def scanned_share(index: CellIndex, requests: DataFrame, nprobe: int) -> float:
    """Part of all request-vector comparisons that the cell search makes."""
    sizes = {r["cell"]: r["n"] for r in index.vectors.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    made = asked = 0
    total = sum(sizes.values())
    for query_ids, queries in request_blocks(requests):
        probes = _probes(queries, index.centres, nprobe)
        per_cell = np.array([sizes.get(c, 0) for c in range(len(index.centres))])
        made += int((probes @ per_cell).sum()) + sizes.get(-1, 0) * len(query_ids)
        asked += total * len(query_ids)
    return made / asked if asked else 0.0
