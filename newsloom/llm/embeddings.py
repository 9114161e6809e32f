"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import components
from newsloom.runtime import settle

COSINE = 0.9
# Rows that the rotation is learned from; every row is indexed.
SAMPLE_ROWS = 20_000
# Least Hamming tables. A code is cut into parts, each the key of one table; when a code has
# fewer parts than tables, more rotations are learned from other starts.
TABLES = 12
# Share of the pairs at the cosine limit that some table finds: longer keys get more tables.
RECALL = 0.95
# Rows of the sample that pairs at the limit are planted at, to see whether they are found.
PLANTED = 2_000
# Vectors that a key of a table has on average, as a power of two.
KEY_BITS = 4
# Vectors of a key that are compared in one block; a fuller key has more blocks.
BLOCK = 512


@dataclass
class Rotation:
    mean: np.ndarray
    turn: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Signs of the centred, rotated vectors as bits."""
        return (unit - self.mean) @ self.turn > 0


def learn_rotation(sample: np.ndarray, bits: int, seed: int = 0, rounds: int = 30) -> Rotation:
    """Iterative quantisation: main directions, then turned until the signs lose least.

    In turn, codes are the signs of the turned rows, and the turn is the orthogonal
    one that takes the rows nearest to the codes. With fewer rows or directions than
    bits, random directions fill up. Even seeds centre the rows, which balances the
    codes; odd ones do not, so that a narrow bundle of vectors keeps common codes.
    """
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) and seed % 2 == 0 else np.zeros(width)
    centred = sample - mean
    random = np.linalg.qr(rng.normal(size=(max(width, bits), max(width, bits))))[0]
    if len(sample) < 2:
        return Rotation(mean, random[:width, :bits])
    axes = np.linalg.svd(centred, full_matrices=False)[2] if len(sample) <= 4 * width else np.linalg.eigh(centred.T @ centred)[1].T[::-1]
    axes = axes[:bits].T
    if axes.shape[1] < bits:
        axes = np.concatenate([axes, random[:width, : bits - axes.shape[1]]], axis=1)
    projected = centred @ axes
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        signs = np.where(projected @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        turn = (left @ right).T
    return Rotation(mean, axes @ turn)


def usable(vector: str = "embedding"):
    """Not null, not empty, all parts finite, not zero."""
    parts = F.col(vector)
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return parts.isNotNull() & (F.size(parts) > 0) & finite & F.exists(parts, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _sample(classes: DataFrame, width: int, rows: int) -> np.ndarray:
    """Unit vectors of one width, the first in hash order: at most ``rows``, and 4 million numbers."""
    some = classes.where(F.size("embedding") == width).orderBy(F.xxhash64("class_id"), "class_id")
    table = some.select("embedding").limit(min(rows, 4_000_000 // width + 1)).toArrow()
    return _unit(_matrix(table.column(0).combine_chunks()))


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a symmetric link matrix reaches."""
    label = np.arange(len(linked))
    while True:
        reached = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        reached = reached[reached]
        if (reached == label).all():
            return label
        label = reached


def tables_for(length: int, cosine: float) -> int:
    """Tables with keys of ``length`` bits that find RECALL of the pairs at ``cosine`` by random signs."""
    agree = (1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi) ** length
    return TABLES if agree >= 1 else max(TABLES, int(np.ceil(np.log(1 - RECALL) / np.log1p(-max(agree, 1e-9)))))


def planted_pairs(sample: np.ndarray, cosine: float, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of the sample and partners at ``cosine``: in random directions, and towards other rows."""
    rng = np.random.default_rng(seed)
    rows = sample[:PLANTED]
    if not len(rows) or rows.shape[1] < 2 or not -1 < cosine < 1:
        return []
    pairs = []
    for aims in (rng.normal(size=rows.shape), sample[rng.permutation(len(sample))[: len(rows)]]):
        aside = aims - (aims * rows).sum(axis=1, keepdims=True) * rows
        size = np.linalg.norm(aside, axis=1)
        some = size > 1e-6
        if some.any():
            aside = aside[some] / size[some, None]
            pairs.append((rows[some], cosine * rows[some] + np.sqrt(1 - cosine * cosine) * aside))
    return pairs


def random_rotation(width: int, bits: int, seed: int) -> Rotation:
    rng = np.random.default_rng([seed, width])
    return Rotation(np.zeros(width), np.linalg.qr(rng.normal(size=(max(width, bits), max(width, bits))))[0][:width, :bits])


def learn_rotations(sample: np.ndarray, width: int, length: int, cosine: float) -> list[Rotation]:
    """Learned rotations for ``tables_for`` tables, and random ones until RECALL of planted pairs is found.

    A random rotation about zero separates a pair by its angle alone, whatever the
    other vectors are, so each brings the planted pairs nearer to being found.
    """
    bits = max(width // length, 1) * length
    turns = [learn_rotation(sample, bits, seed=r) for r in range(-(-tables_for(length, cosine) * length // bits))]
    pairs = planted_pairs(sample, cosine)

    def meet(turn: Rotation, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        same = turn.codes(one) == turn.codes(other)
        return same.reshape(len(one), -1, length).all(axis=2).any(axis=1)

    found = [np.any([meet(t, *pair) for t in turns], axis=0) for pair in pairs]
    while any(f.mean() < RECALL for f in found):
        turns.append(random_rotation(width, bits, len(turns)))
        found = [f | meet(turns[-1], *pair) for f, pair in zip(found, pairs)]
    return turns


FOUND = "class_id long, reached long, links long"


def linked_classes(classes: DataFrame, cosine: float, sample_rows: int) -> DataFrame:
    """``class_id, reached, links``: per block, the copies linked to a class and a class it reaches.

    A pair of classes counts in the first table only where their keys agree. Per block
    the result has a row for each class with links, never one for each pair.
    """
    total = classes.count()
    widths = sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect())
    length = int(np.clip(np.log2(max(total, 2)) - KEY_BITS, 4, 40))
    turns = {w: learn_rotations(_sample(classes, w, sample_rows), w, length, cosine) for w in widths}
    parts = {w: max(w // length, 1) for w in widths}
    # All widths get as many tables as the one that needs most.
    tables = max([TABLES, *(len(turns[w]) * parts[w] for w in widths)])
    for w in widths:
        turns[w] += [random_rotation(w, parts[w] * length, r) for r in range(len(turns[w]), -(-tables // parts[w]))]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        weights = 1 << np.arange(length, dtype=np.int64)
        for whole in batches:
            sizes = pc.list_value_length(whole.column("embedding")).to_numpy(zero_copy_only=False)
            for width in np.unique(sizes):
                batch = whole.filter(pa.array(sizes == width))
                unit = _unit(_matrix(batch.column("embedding")))
                bits = [r.codes(unit).reshape(len(unit), -1, length) @ weights for r in turns[int(width)]]
                keys = np.concatenate(bits, axis=1)[:, :tables]
                # Vectors of another width never meet.
                keys = (keys + (np.int64(width) << np.int64(length))).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    coded = settle(
        classes.mapInArrow(code, "embedding array<double>, class_id long, copies long, keys array<long>"), "vector-codes"
    )
    keyed = coded.select("*", F.posexplode("keys").alias("table", "key"))
    full = keyed.groupBy("table", "key").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    placed = keyed.join(full, ["table", "key"]).select(
        "class_id", "embedding", "copies", "keys", "table", "key", blocks.alias("blocks")
    ).withColumn("block", F.pmod(F.xxhash64("class_id", "table"), "blocks").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "meeting", F.xxhash64("table", "key", F.least("block", "other"), F.greatest("block", "other"))
    ).withColumn("second", (F.col("block") > F.col("other")))
    groups = max(1, total * tables // 8_000 + 1)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("meeting", "ascending"), ("second", "ascending"), ("class_id", "ascending")])
        meeting = table.column("meeting").to_numpy()
        second = table.column("second").to_numpy(zero_copy_only=False)
        within = (table.column("block").to_numpy() == table.column("other").to_numpy())
        ids, copies, number = (table.column(c).to_numpy() for c in ("class_id", "copies", "table"))
        keys = _matrix(table.column("keys").combine_chunks()).astype(np.int64)
        vectors = table.column("embedding").combine_chunks()
        edges = np.flatnonzero(np.concatenate([[True], meeting[1:] != meeting[:-1], [True]]))
        out = []
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            if b - a < 2:
                continue
            unit = _unit(_matrix(vectors.slice(a, b - a)))
            linked = unit @ unit.T >= cosine
            np.fill_diagonal(linked, False)
            if not within[a]:
                linked &= second[a:b, None] != second[None, a:b]
            if not linked.any():
                continue
            label = _labels(linked)
            left, right = np.nonzero(linked)
            before = (keys[a + left, : number[a]] == keys[a + right, : number[a]]).any(axis=1)
            counts = np.bincount(left[~before], copies[a + right[~before]], minlength=b - a).astype(np.int64)
            some = np.flatnonzero(linked.any(axis=1))
            out.append((ids[a + some], ids[a + label[some]], counts[some]))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*out) if out else [[], [], []])]
        return pa.table({"class_id": columns[0], "reached": columns[1], "links": columns[2]})

    columns = ["class_id", "embedding", "copies", "keys", "table", "block", "other", "meeting", "second"]
    dealt = met.select(*columns, F.pmod(F.xxhash64("meeting"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(compare, FOUND)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: links are pairs of cosine >= ``cosine``.

    Equal vectors are one class, so copies are never compared. A class stands in each
    table under one part of its code; the classes of a key are compared, in blocks of
    bounded size, by their original vectors in double precision. No key, block or link
    is capped; a pair is missed only if its codes differ in every part. The number of
    tables follows from the length of the keys, so that about RECALL of the pairs at the
    limit are found whatever the number of rows; nearer pairs are missed less often.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest
    vec_id that links reach, ``kept`` marks it. Vectors that are null, empty, zero or
    hold null or non-finite parts, and rows without an id, link with nothing; vectors
    of other widths neither. Repeated rows are linked copies; an empty table gives no
    rows; other columns are not looked at.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("good", usable() & F.col("vec_id").isNotNull())
    classes = settle(
        rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies")),
        "vector-classes",
    )
    found = settle(linked_classes(classes, cosine, sample_rows), "vector-links")
    reached = components(found.select(F.col("class_id").alias("a"), F.col("reached").alias("b")))
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    known = (
        classes.join(links, "class_id", "left")
        .join(reached.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
        .select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    linked = rows.where("good").join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
