"""Exact nearest neighbours by cosine distance for a table of requests.

Vectors stay in the partitions they are read in. Each task scores its Arrow
batches against a block of requests with a matrix product and keeps only the
best ``k`` per request, so a shuffle carries ``k`` rows per request and task,
however large the corpus is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import fresh_path, in_scope, settle

RESULT = "query_id bigint, article_id bigint, distance double"
# Requests held by one task at a time; more requests mean more passes over the vectors.
BLOCK_REQUESTS = 1024
# Vectors scored in one matrix product.
SLICE_ROWS = 2048
# Room for the rounding of the matrix product, settled by the second, row-wise product.
SLACK = 1e-9


class Shortlist:
    """The best ``k`` vectors per request seen so far by one task."""

    def __init__(self, queries: np.ndarray, k: int):
        self.k = k
        self.queries = queries
        self.lengths = np.sqrt((queries * queries).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            self.units = queries / self.lengths[:, None]
        self.distances = np.full((len(queries), k), np.inf)
        self.ids = np.zeros((len(queries), k), dtype=np.int64)
        self.filled = np.zeros(len(queries), dtype=np.int64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> None:
        """Score vectors against the requests numbered ``rows``."""
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = 1.0 - (vectors / lengths[:, None]) @ self.units[rows].T
        scores[np.isnan(scores)] = np.inf
        if len(ids) > self.k:
            kth = np.partition(scores, self.k - 1, axis=0)[self.k - 1]
        else:
            kth = np.full(len(rows), np.inf)
        full = self.filled[rows] == self.k
        kth = np.where(full, np.minimum(kth, self.distances[rows, -1]), kth)
        close = scores <= kth + SLACK
        if close.sum() > 4 * self.k * len(rows):
            close &= first_copies(ids, vectors, self.k)[:, None]
        for column, row in enumerate(rows):
            hits = np.flatnonzero(close[:, column])
            if len(hits):
                self._merge(row, ids[hits], vectors[hits], lengths[hits])

    def _merge(self, row, ids, vectors, lengths) -> None:
        # Row-wise sums give equal vectors equal distances, which a matrix product does not promise.
        with np.errstate(invalid="ignore", divide="ignore"):
            exact = 1.0 - (vectors * self.queries[row]).sum(axis=1) / (lengths * self.lengths[row])
        exact[np.isnan(exact)] = np.inf
        kept = self.filled[row]
        distances = np.concatenate([self.distances[row, :kept], exact])
        all_ids = np.concatenate([self.ids[row, :kept], ids])
        order = np.lexsort((all_ids, distances))[: self.k]
        self.filled[row] = len(order)
        self.distances[row, : len(order)] = distances[order]
        self.ids[row, : len(order)] = all_ids[order]

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        used = np.arange(self.k)[None, :] < self.filled[:, None]
        distances = self.distances[used]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(query_ids, self.filled)),
                pa.array(self.ids[used]),
                pa.array(distances, mask=np.isinf(distances)),
            ],
            ["query_id", "article_id", "distance"],
        )


def first_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Marks the ``k`` smallest ids of each distinct vector. Copies are equally far from
    every request, so no others can reach a shortlist."""
    keep = np.zeros(len(ids), dtype=bool)
    seen: dict[bytes, int] = {}
    for row in np.argsort(ids):
        content = vectors[row].tobytes()
        count = seen.get(content, 0)
        if count < k:
            seen[content] = count + 1
            keep[row] = True
    return keep


def as_matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """List column to matrix; a missing vector or one of another width becomes NaN."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = sizes == width
    flat = vectors.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
    if good.all():
        return flat.astype(np.float64).reshape(-1, width)
    out = np.full((len(sizes), width), np.nan)
    out[good] = flat.reshape(-1, width)
    return out


def scorer(block, k: int):
    """Task body: read (article_id, embedding[, cell]) batches, return the shortlist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, probes = block.value
        best = Shortlist(queries, k)
        everyone = np.arange(len(query_ids))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                vectors = as_matrix(part.column(1), queries.shape[1])
                if probes is None:
                    best.offer(ids, vectors, everyone)
                    continue
                cells = part.column(2).to_numpy(zero_copy_only=False)
                for cell in np.unique(cells):
                    asking = everyone if cell < 0 else np.flatnonzero(probes[:, cell])
                    inside = cells == cell
                    if len(asking):
                        best.offer(ids[inside], vectors[inside], asking)
        yield best.rows(query_ids)

    return run


def request_blocks(requests: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Request ids and vectors in blocks of bounded size; the driver holds one at a time."""
    asked = requests.select("query_id", F.col("query_vec").cast("array<double>"))
    total = asked.count()
    blocks = 1
    if total > BLOCK_REQUESTS:
        blocks = math.ceil(1.2 * total / BLOCK_REQUESTS)
        number = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        asked = settle(asked.withColumn("block", number), "requests", ["block"])
    for number in range(blocks):
        part = asked.where(F.col("block") == number) if blocks > 1 else asked
        rows = part.select("query_id", "query_vec").collect()
        if rows:
            widths = {len(row[1]) for row in rows}
            if len(widths) > 1:
                raise ValueError(f"request vectors differ in width: {sorted(widths)}")
            yield np.array([row[0] for row in rows], dtype=np.int64), np.array([row[1] for row in rows])


def best_per_request(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "article_id")
    return scored.withColumn("_rank", F.row_number().over(order)).where(f"_rank <= {k}").drop("_rank")


def in_passes(spark, blocks: Iterable, vectors_for: Callable, k: int) -> DataFrame:
    """Search one block of requests after the other, each over its own choice of vectors.

    The blocks share no request, so each pass is final. Every pass but a single one is
    written before the next block is fetched.
    """
    path, waiting = None, []
    for number, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(block)
        scored = vectors_for(block).mapInArrow(scorer(sent, k), RESULT)
        waiting.append((best_per_request(scored, k), sent))
        if number == 0:
            continue
        path = path or in_scope(fresh_path(spark, "passes"))
        for result, used in waiting:
            result.write.mode("append").parquet(path)
            used.destroy()
        waiting.clear()
    if path:
        return spark.read.schema(RESULT).parquet(path)
    return waiting[0][0] if waiting else spark.createDataFrame([], RESULT)


def nearest(embeddings: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest articles of each request: (query_id, article_id, distance).

    Ties go to the smaller article_id; a vector without a distance comes last.
    """
    vectors = embeddings.select("article_id", "embedding")
    blocks = ((ids, queries, None) for ids, queries in request_blocks(requests)) if k > 0 else ()
    return in_passes(embeddings.sparkSession, blocks, lambda _: vectors, k)
