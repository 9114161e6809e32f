"""Spelling variants: words one edit apart, found through length-sharded blocked Bloom filters.

The vocabulary (distinct words and their counts) is built with Spark functions. Every
word then writes its own filter bits, the bits are OR-ed by Spark and the filters,
of a size bounded before they are built, are broadcast. Each word hashes all its
deletions and replacements with numpy, without making strings, and probes the filter
of the resulting length; only positives become rows, and an exact join with the
vocabulary removes the false ones. Insertions are the deletions seen from the longer
word, so every near pair is found from at least one side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import mixed, slices
from newsloom.runtime import settle

# Fixed values of the contract: letters of a run, the rule of deletion, least length and count.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETE_EVERY = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
FORM_RATIO = 10

# The letters a word can hold once A-Z are lower-cased: a-z and U+00C0..U+00FF.
LETTERS = np.array([ord(c) for c in LOWER] + list(range(0xC0, 0x100)), np.uint64)
# Bloom filters: bits per word while the filters fit in FILTER_BYTES (their bound when
# broadcast); beyond it fewer bits per word, more false positives, the same results.
BITS_PER_WORD = 12
FILTER_BYTES = 16 << 20
BLOCK_WORDS = 8  # 512-bit blocks: one cache line holds all bits of a key
PROBES = 4
# Candidate hashes a task holds at once.
CHUNK = 1 << 20
BASE = np.uint64(0x100000001B3)
BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def words_of(docs: DataFrame) -> DataFrame:
    """``word, n``: the contract's words (at least 7 code points, at least 2 occurrences).

    Runs come from whole texts (null: none); a null ``doc_id`` is written as the empty
    string in the hashed ``<doc_id>:<run>``. Counts are partial sums before the shuffle,
    so a word in a third of all rows costs one row per task.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({RUN})"), 1)).alias("run"),
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    cut = F.expr("concat(substring(run, 1, _at), substring(run, _at + 2))")
    word = F.when(h % DELETE_EVERY == 0, cut).otherwise(F.col("run"))
    return (
        runs.withColumn("_at", (h % F.length("run")).cast("int"))
        .select(word.alias("word"))
        .where(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length as rows of a matrix."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return flat.reshape(len(words), length)


def _powers(length: int) -> np.ndarray:
    """BASE to the powers length-1 .. 0 (mod 2^64)."""
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(length - 1, 0), BASE)]), dtype=np.uint64)
    return up[::-1].copy()


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes mod 2^64 of rows of code points; only probes use them, so a
    collision costs a false positive that the exact join removes, never a lost pair."""
    with np.errstate(over="ignore"):
        return (codes * _powers(codes.shape[1])).sum(1, dtype=np.uint64)


def edit_hashes(codes: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all deletions (n x L) and of the replacements by LETTERS at places
    ``first`` to ``last`` (n x places x letters)."""
    with np.errstate(over="ignore"):
        powers = _powers(codes.shape[1])
        terms = codes * powers
        whole = terms.sum(1, dtype=np.uint64)
        before = np.cumsum(terms, 1, dtype=np.uint64) - terms
        deletions = before * BASE_INVERSE + (whole[:, None] - before - terms)
        places = slice(first, last)
        step = (LETTERS[None, None, :] - codes[:, places, None]) * powers[None, places, None]
        replacements = whole[:, None, None] + step
    return deletions, replacements


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its PROBES bits there (word in block, bit in word)."""
    mixed_hash = mixed(hashes)
    block = (mixed_hash % np.uint64(blocks)).astype(np.int64)
    again = mixed(mixed_hash ^ np.uint64(0x9E3779B97F4A7C15))
    bits = np.stack([(again >> np.uint64(9 * k)) & np.uint64(511) for k in range(PROBES)], -1)
    return block, bits.astype(np.int64)


def blocks_for(words: int, bits_per_word: float) -> int:
    return max(1, int(np.ceil(words * bits_per_word / (64 * BLOCK_WORDS))))


def probe(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set: no false negatives."""
    blocks = len(filter_words) // BLOCK_WORDS
    block, bits = _places(hashes, blocks)
    index = block[..., None] * BLOCK_WORDS + (bits >> 6)
    got = (filter_words[index] >> (bits & 63).astype(np.uint64)) & np.uint64(1)
    return got.all(-1)


def build_filters(vocab: DataFrame) -> dict[int, np.ndarray]:
    """One blocked Bloom filter per word length, built by the tasks and OR-ed by Spark.

    The sizes are fixed from the counts per length before any bit is set, and their
    sum is at most FILTER_BYTES (plus one block per length): the bound of the broadcast.
    """
    per_length = {r.length: r.n for r in vocab.groupBy(F.length("word").alias("length")).count().withColumnRenamed("count", "n").collect()}
    total = sum(per_length.values())
    bits = min(float(BITS_PER_WORD), FILTER_BYTES * 8 / max(total, 1))
    sizes = {length: blocks_for(n, bits) for length, n in per_length.items()}

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            words = batch.column("word").to_pylist()
            by_length: dict[int, list[str]] = {}
            for w in words:
                by_length.setdefault(len(w), []).append(w)
            for length, group in by_length.items():
                block, bit = _places(word_hashes(_codes(group, length)), sizes[length])
                index = (block[:, None] * BLOCK_WORDS + (bit >> 6)).ravel()
                value = (np.uint64(1) << (bit & 63).astype(np.uint64)).ravel().view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"length": pa.array(np.full(len(index), length, np.int32)), "at": pa.array(index), "bits": pa.array(value)}
                )

    rows = (
        vocab.select("word")
        .mapInArrow(set_bits, "length int, at long, bits long")
        .groupBy("length", "at")
        .agg(F.bit_or("bits").alias("bits"))
    )
    filters = {length: np.zeros(blocks * BLOCK_WORDS, np.uint64) for length, blocks in sizes.items()}
    table = rows.toArrow()
    for length in filters:
        chosen = table.filter(pc.equal(table.column("length"), length))
        at = chosen.column("at").to_numpy()
        filters[length][at] = chosen.column("bits").to_numpy().view(np.uint64)
    return filters


def candidates(vocab: DataFrame, filters: dict[int, np.ndarray]) -> DataFrame:
    """``word, other``: edits of each word that its filters let through (some false)."""
    shared = vocab.sparkSession.sparkContext.broadcast(filters)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in slices(batches, "word"):
            by_length: dict[int, list[str]] = {}
            for w in batch.column("word").to_pylist():
                by_length.setdefault(len(w), []).append(w)
            for length, group in by_length.items():
                step = max(1, CHUNK // (length * len(LETTERS)))
                for at in range(0, len(group), step):
                    yield from _edits_of(group[at : at + step], length, held)

    return vocab.select("word").mapInArrow(edits, "word string, other string")


def _edits_of(part: list[str], length: int, held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Positives of the words of one length: deletions, then replacements a window of places at a time."""
    codes = _codes(part, length)
    width = max(1, CHUNK // (len(part) * len(LETTERS)))
    for first in range(0, length, width):
        deletions, replacements = edit_hashes(codes, first, first + width)
        words, others = [], []
        if first == 0 and length - 1 in held:
            rows, places = np.nonzero(probe(held[length - 1], deletions))
            for r, p in zip(rows.tolist(), places.tolist()):
                words.append(part[r])
                others.append(part[r][:p] + part[r][p + 1 :])
        if length in held:
            hit = probe(held[length], replacements)
            hit &= LETTERS[None, None, :] != codes[:, first : first + width, None]
            rows, places, letters = np.nonzero(hit)
            for r, p, k in zip(rows.tolist(), (places + first).tolist(), letters.tolist()):
                words.append(part[r])
                others.append(part[r][:p] + chr(int(LETTERS[k])) + part[r][p + 1 :])
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "other": pa.array(others, pa.string())})


def near_pairs(vocab: DataFrame) -> DataFrame:
    """``word, other``, both ways: every pair of vocabulary words one edit apart, once."""
    found = candidates(vocab, build_filters(vocab))
    exact = found.join(vocab.select(F.col("word").alias("other")), "other", "left_semi").select("word", "other")
    return exact.union(exact.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the contract.

    A word's form is its near word of largest count, ties to the smallest in code-point
    order, when that count is at least ten times its own; else null. The root follows
    forms to the end (counts grow tenfold a step, so chains are short and never loop).
    Null and empty texts add no runs, repeated rows count again, an empty table gives
    no rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    vocab = settle(words_of(docs), "vocabulary")
    pairs = settle(near_pairs(vocab), "near-pairs")
    partner = vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = (
        pairs.join(partner, "other")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("neg"), F.col("other").alias("other"))).alias("best"))
    )
    rows = vocab.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.neg") >= FORM_RATIO * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.neg") >= FORM_RATIO * F.col("n"), -F.col("best.neg")).cast("long").alias("form_n"),
    )
    rows = settle(rows, "forms")
    return roots(rows)


def roots(rows: DataFrame) -> DataFrame:
    """Follow ``form`` to its end by pointer jumping, each round written before the next."""
    step = rows.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = settle(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        moved = jumped.join(step.withColumnRenamed("root", "before"), "word").where("root <> before")
        step = jumped
        if moved.isEmpty():
            break
    return rows.join(step, "word").select("word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n")
