"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, slices
from newsloom.runtime import settle

# Wide enough that the words of a long text do not meet the chosen features by chance of hashes.
BITS = 31
GRAMS = (4, 5, 6)
# Bounds of the training sample: labelled rows per label, and features that the fit uses.
ROWS_PER_LABEL = 2_000
FEATURES = 5_000
# A feature counts in a document at most this often, in the fit and in scoring.
MOST = 3

# Words whose features a task keeps; a full table starts anew.
KNOWN_WORDS = 150_000
# Words whose features are made at once.
AT_ONCE = 20_000

SCORED = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words (whole word and byte n-grams of ``^word$``), and whose they are."""
    raw = np.frombuffer(("^" + "$^".join(words) + "$").encode() if words else b"", np.uint8)
    ends = np.flatnonzero(raw == ord("$")) + 1
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    owner = np.repeat(np.arange(len(ends)), ends - begins)
    room = np.repeat(ends, ends - begins) - np.arange(len(raw))
    codes = raw.astype(np.uint64) + np.uint64(1)
    found, whose = [], []
    rolling = np.zeros(len(raw), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([codes[n - 1 :], np.zeros(min(n - 1, len(raw)), np.uint64)])
        if n in GRAMS:
            keep = room >= n
            found.append(rolling[keep] * np.uint64(2 * n + 1))
            whose.append(owner[keep])
    if len(ends):
        powers = np.cumprod(np.full(1 + int((ends - begins).max()), 0x100000001B3, np.uint64))
        mixed = codes * powers[np.arange(len(raw)) - np.repeat(begins, ends - begins)]
        found.append(np.add.reduceat(mixed, begins))
        whose.append(np.arange(len(ends)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.concatenate(found)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(whose)


def document_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of a document's distinct words, and how often each is there."""
    features, counts = np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(words), AT_ONCE):
        fresh, times = np.unique(word_features(words[at : at + AT_ONCE])[0], return_counts=True)
        features, place = np.unique(np.concatenate([features, fresh]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, times]))
    return features, counts


def places(features: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each feature stands in the sorted ``known``, -1 where it does not."""
    place = np.minimum(np.searchsorted(known, features), len(known) - 1)
    return np.where(known[place] == features, place, -1) if len(known) else np.full(len(features), -1)


def words_of(text: str) -> set[str]:
    """Distinct lower-case words; the marks at the ends of a word are cut off."""
    return {w for w in (x.strip(".,;:!?\"'()[]|*#%&$^") for x in text.lower().replace("$", " ").replace("^", " ").split()) if w}


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(bounds[k] - weights . features), one weight vector for all bounds.

    ``features`` are those with a weight, sorted; all others weigh nothing.
    """

    features: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    threshold: float = 0.5

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.bounds[None, :] - scores[:, None], -60, 60)))
        edges = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1)
        return np.diff(edges, axis=1)

    def word_parts(self, words: list[str]) -> list[tuple[int, ...]]:
        """The places in ``features`` of each word's features."""
        parts: list[tuple[int, ...]] = [()] * len(words)
        for first in range(0, len(words), AT_ONCE):
            features, owner = word_features(words[first : first + AT_ONCE])
            features = places(features, self.features)
            features, owner = features[features >= 0], owner[features >= 0]
            order = np.argsort(owner, kind="stable")
            whose, begins = np.unique(owner[order], return_index=True)
            for word, held in zip(whose.tolist(), np.split(features[order], begins[1:])):
                parts[first + word] = tuple(held.tolist())
        return parts


@dataclass
class Sample:
    """Labelled rows in order of their id: ``row`` numbers, and their features and words as a table."""

    ids: np.ndarray
    table: DataFrame

    def __len__(self) -> int:
        return len(self.ids)


@dataclass
class Entries:
    """Counts of the chosen features in sampled rows, as a sparse matrix."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    chosen: np.ndarray

    def of(self, wanted: np.ndarray) -> Entries:
        """The rows where ``wanted`` is true, numbered anew."""
        some = wanted[self.rows]
        return Entries((np.cumsum(wanted) - 1)[self.rows[some]], self.columns[some], self.values[some], self.chosen)

    def scores(self, model: OrdinalModel, total: int) -> np.ndarray:
        place = places(self.chosen, model.features)
        weights = np.where(place >= 0, np.append(model.weights, 0.0)[place], 0.0)
        return np.bincount(self.rows, self.values * weights[self.columns], minlength=total)


def chosen_features(sample: Sample, toxic: np.ndarray, held: np.ndarray) -> Entries:
    """The FEATURES that speak most for a toxic row, and their counts in every sampled row.

    Each must stand in 1 % of the toxic rows, and eight times as often as in clean ones;
    rows of ``held`` have no say. The rows that have a feature are counted by Spark, so the
    driver holds the chosen features and their counts alone.
    """
    aside = frozenset(sample.ids[held].tolist())

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "found", 32 << 20):
            listed = list(zip(*(batch.column(c).to_pylist() for c in ("row", "_toxic", "found"))))
            for label in (0, 1):
                raw = b"".join(f for row, t, f in listed if t == label and row not in aside)
                features, counts = np.unique(np.frombuffer(raw, np.int32), return_counts=True)
                columns = [features.astype(np.int64), counts * (1 - label), counts * label]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["feature", "clean", "toxic"])

    parts = sample.table.select("row", "_toxic", "found").mapInArrow(see, "feature long, clean long, toxic long")
    clean_rows, toxic_rows = np.bincount(toxic[~held], minlength=2).tolist()
    share = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    lift = share("toxic", toxic_rows) / share("clean", clean_rows)
    speaking = (
        parts.groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= max(3, 0.01 * toxic_rows)) & (lift >= 8))
        .orderBy((F.log(lift) * F.sqrt(F.col("toxic") + F.col("clean"))).desc(), "feature")
    )
    chosen = np.array(sorted(r[0] for r in speaking.select("feature").limit(FEATURES).collect()), np.int64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, values = [], []
            for found, count in zip(batch.column("found").to_pylist(), batch.column("count").to_pylist()):
                column = places(np.frombuffer(found, np.int32), chosen)
                columns.append(column[column >= 0].astype(np.int32).tobytes())
                values.append(np.frombuffer(count, np.uint8)[column >= 0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(columns, pa.binary()), pa.array(values, pa.binary())], names=["row", "columns", "counts"]
            )

    picked = sample.table.select("row", "found", "count").mapInArrow(pick, "row long, columns binary, counts binary").toArrow()
    number = {row: i for i, row in enumerate(sample.ids.tolist())}
    order = np.argsort([number[r] for r in picked.column("row").to_pylist()])
    columns = [np.frombuffer(picked.column("columns")[i].as_py(), np.int32) for i in order.tolist()]
    values = [np.frombuffer(picked.column("counts")[i].as_py(), np.uint8) for i in order.tolist()]
    owner = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    return Entries(owner, np.concatenate(columns), np.concatenate(values).astype(float), chosen)


def fit_ordinal(entries: Entries | None, grades: np.ndarray, l1: float = 6e-3, rounds: int = 300) -> OrdinalModel:
    """Fit shared weights and ordered bounds by proximal gradient steps.

    A first fit with an L1 penalty picks features, a second one without it fits them.
    Weights stay at 0 or above: words raise a grade, and the many plain words of a
    long text cannot outweigh them.

    A feature's value is how often a document's distinct words have it, MOST at most.
    Without rows, or with one grade alone, the model puts everything into that grade.
    """
    levels = int(grades.max()) + 1 if len(grades) else 1
    if entries is None or levels < 2 or len(set(grades.tolist())) < 2:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.full(max(levels - 1, 1), 20.0))
    rows, columns, values, chosen = entries.rows, entries.columns, entries.values, entries.chosen
    times = lambda w: np.bincount(rows, values * w[columns], minlength=len(grades))
    back = lambda e: np.bincount(columns, values * e[rows], minlength=len(chosen))

    def step_for(picked: np.ndarray) -> float:
        probe, norm = picked.astype(float), 1.0
        for _ in range(20):
            probe = picked * back(times(probe))
            norm = max(np.linalg.norm(probe), 1e-12)
            probe /= norm
        return 1 / (norm / len(grades) / 2 + 1e-9)

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    reached = np.array([np.mean(grades <= k) for k in range(levels - 1)])
    bounds = np.log(reached / (1 - reached))
    w = previous = np.zeros(len(chosen))
    picked = np.ones(len(chosen), bool)
    step = step_for(picked)
    for turn in range(6 * rounds):
        if turn == rounds:
            picked, previous, l1 = w != 0, w, 0.0
            step = step_for(picked)
            used = picked[columns]
            columns, rows, values = columns[used], rows[used], values[used]
        since = turn if turn < rounds else turn - rounds
        momentum = since / (since + 3)
        ahead = w + momentum * (w - previous)
        score = times(ahead)
        upper = np.where(grades < levels - 1, sigmoid(bounds[np.minimum(grades, levels - 2)] - score), 1.0)
        lower = np.where(grades > 0, sigmoid(bounds[np.maximum(grades - 1, 0)] - score), 0.0)
        share = np.maximum(upper - lower, 1e-9)
        slope = (upper * (1 - upper) - lower * (1 - lower)) / share
        previous, w = w, picked * (ahead - step * back(slope) / len(grades))
        w = np.maximum(w - step * l1, 0)
        for k in range(levels - 1):
            pull = np.sum(np.where(grades == k, upper * (1 - upper) / share, 0)) - np.sum(
                np.where(grades == k + 1, lower * (1 - lower) / share, 0)
            )
            bounds[k] += 2.0 * pull / len(grades)
        bounds = np.maximum.accumulate(bounds + np.arange(levels - 1) * 1e-6)
    return OrdinalModel(chosen[w != 0], w[w != 0], bounds)


def severity_grades(sample: Sample, toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 2 from a 0/1 label: toxic rows split at the median number of marked words.

    Marked are words that stand in at least three toxic rows and ten times as often
    in toxic rows as in clean ones. Without a marked word a toxic row has grade 1.
    """
    ratio = (np.sum(toxic == 0) + 1) / (np.sum(toxic == 1) + 1)
    words = sample.table.select("row", "_toxic", F.explode("words").alias("word"))
    rows = words.groupBy("word").agg(F.sum("_toxic").alias("n"), F.sum(1 - F.col("_toxic")).alias("clean"))
    marked = rows.where((F.col("n") >= 3) & (F.col("n") * float(ratio) >= 10 * (F.col("clean") + 0.1))).select("word")
    held = words.where("_toxic = 1").join(marked, "word").groupBy("row").count()
    counts = {r[0]: r[1] for r in held.collect()}
    count = np.array([counts.get(row, 0) for row in sample.ids.tolist()])
    middle = np.median(count[toxic == 1]) if (toxic == 1).any() else 0.0
    return np.where(toxic == 1, 1 + (count > middle), 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> tuple[Sample, np.ndarray]:
    """At most ``rows_per_label`` labelled documents for each label, the first in hash order, of any length.

    Texts become features and words where they are; the driver gets numbers of rows and labels.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("_toxic"))
    full = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND octet_length(text) >= 1")
    usable = full.select("doc_id").join(known, "doc_id")
    order = F.xxhash64("doc_id")
    first = [usable.where(F.col("_toxic") == x).orderBy(order, "doc_id").limit(rows_per_label) for x in (0, 1)]
    chosen = first[0].union(first[1]).dropDuplicates(["doc_id"])
    rows = full.join(F.broadcast(chosen), "doc_id").select("doc_id", "_toxic", "text", F.xxhash64("text").alias("print"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, counts, listed = [], [], []
            for text in batch.column("text").to_pylist():
                words = sorted(words_of(text))
                features, times = document_features(words)
                found.append(features.astype(np.int32).tobytes())
                counts.append(np.minimum(times, MOST).astype(np.uint8).tobytes())
                listed.append(words)
            columns = [pa.array(found, pa.binary()), pa.array(counts, pa.binary()), pa.array(listed, pa.list_(pa.string()))]
            kept = [batch.column(c) for c in ("doc_id", "_toxic", "print")]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=["doc_id", "_toxic", "print", "found", "count", "words"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _toxic int, print long, found binary, count binary, words array<string>"
    table = settle(rows.mapInArrow(read, schema).withColumn("row", F.monotonically_increasing_id()), "labelled-sample")
    order = [("doc_id", "ascending"), ("print", "ascending"), ("row", "ascending")]
    listed = table.select("doc_id", "print", "row", "_toxic").toArrow().sort_by(order)
    ids, toxic = (np.array(listed.column(c).to_pylist(), np.int64) for c in ("row", "_toxic"))
    return Sample(ids, table), toxic


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> OrdinalModel:
    """Fit on four fifths of a bounded labelled sample, set the threshold on the last fifth.

    The threshold is the median of those of 81 even steps from 0.1 to 0.9 that make
    the fewest held-out errors, a clean row wrongly rejected weighing four times as
    much. With fewer than 10 held-out rows all rows fit and the threshold stays 0.5.
    """
    sample, toxic = labelled_sample(docs, labels, rows_per_label)
    held = np.arange(len(sample)) % 5 == 4
    held &= held.sum() >= 10
    if not len(sample):
        return fit_ordinal(None, toxic)
    grades = severity_grades(sample, toxic)
    entries = chosen_features(sample, toxic, held)
    model = fit_ordinal(entries.of(~held), grades[~held])
    if not held.any():
        return model
    chance = 1 - model.probabilities(entries.of(held).scores(model, int(held.sum())))[:, 0]
    wrong = lambda t: 4 * np.sum((chance >= t) & (toxic[held] == 0)) + np.sum((chance < t) & (toxic[held] == 1))
    tried = np.linspace(0.1, 0.9, 81)
    errors = np.array([wrong(t) for t in tried])
    model.threshold = float(np.median(tried[errors == errors.min()]))
    return model


def document_scores(model: OrdinalModel, texts: list[str], known: dict[str, tuple[int, ...]] | None = None) -> np.ndarray:
    """Sum of weights times counts in each document's distinct words, a count MOST at most as in the fit."""
    known = {} if known is None else known
    sets = [words_of(t) for t in texts]
    new = sorted(set().union(*sets) - known.keys()) if sets else []
    known.update(zip(new, model.word_parts(new)))
    counts = [Counter(chain.from_iterable(map(known.__getitem__, words))) for words in sets]
    return np.array([math.fsum(min(n, MOST) * model.weights[f] for f, n in count.items()) for count in counts])


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic`` for every row, from its whole text.

    ``severity`` is the expected grade, ``grade`` the likeliest, ``toxic`` whether
    P(grade > 0) reaches the model's threshold. A null or empty text has no words and
    gets the model's prior; repeated rows get equal results; other columns are not
    looked at; an empty table gives no rows.
    """
    schema = arrow_rows(SCORED)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, "text"):
            if len(known) > KNOWN_WORDS:
                known.clear()
            scores = document_scores(model, batch.column("text").to_pylist(), known)
            chances = model.probabilities(scores)
            risk = 1 - chances[:, 0]
            columns = [batch.column("doc_id"), chances @ np.arange(chances.shape[1]), chances.argmax(1), risk, risk >= model.threshold]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(score, SCORED)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they were."""
    model = fit_toxicity(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, "text"):
            if len(known) > KNOWN_WORDS:
                known.clear()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            risk = 1 - model.probabilities(document_scores(model, texts, known))[:, 0]
            yield batch.filter(pa.array(risk < model.threshold))

    return docs.mapInArrow(keep, docs.schema)
