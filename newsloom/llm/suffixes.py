"""Deduplication of repeated stretches by suffix order and longest previous factors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import RollingHash, mixed, slices
from newsloom.runtime import BROADCAST_IDS, settle, small_if_counted

MIN_BYTES = 400
SLICE = 1 << 20
# Different surroundings of one anchor that are put in suffix order together; an
# anchor with more is split into narrower ones.
GROUP_REGIONS = 512
BUCKET_REGIONS = 1_500

REGIONS = "h long, rh long, doc long, crc long, p int, a int, b int"
_NAMES = [c.split()[0] for c in REGIONS.split(", ")]


def _binary(values: pa.Array) -> list[bytes]:
    return [t or b"" for t in values.cast(pa.binary()).to_pylist()]


def _long(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def _batches(columns: list, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(columns[0]), 65_536):
        part = [pa.array(c[first : first + 65_536], t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(part, names=names)


_TYPES = [pa.int64()] * 4 + [pa.int32()] * 3


def anchors(docs: DataFrame, least: int) -> DataFrame:
    """Cut the possible starts of ``least``-byte strings into runs with a common anchor.

    The anchor of a string is the place, in it, of its half-length substring with the
    least hash, so equal strings have equal anchors at equal distances. A row has the
    anchor's hash ``h`` and place ``p``, the run of starts ``a..b`` and the hash ``rh``
    of the region of all their strings.
    """
    half = least // 2
    width = least - half + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for batch in slices(batches, "text", SLICE):
            texts = _binary(batch.column("text"))
            long = [i for i, t in enumerate(texts) if len(t) >= least]
            if not long:
                continue
            buffer = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
            rolling.read(buffer)
            ends = np.cumsum([len(texts[i]) for i in long])
            begins = ends - [len(texts[i]) for i in long]
            at = np.arange(len(buffer) - half + 1)
            grams = rolling.of(at, at + half)
            # Least hash in each window, the earlier place on a tie: upper half hash, lower half place.
            marked = (grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
            pad = -len(marked) % width
            blocks = np.concatenate([marked, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
            ahead = np.minimum.accumulate(blocks, axis=1).ravel()
            behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            starts = len(marked) - width + 1
            chosen = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            owner = np.repeat(np.arange(len(long)), ends - begins)[:starts]
            good = np.arange(starts) + least <= ends[owner]
            place = np.flatnonzero(good)
            new = np.concatenate([[True], (chosen[place][1:] != chosen[place][:-1]) | (owner[place][1:] != owner[place][:-1])])
            a = place[new]
            b = place[np.concatenate([new[1:], [True]])]
            p, who = chosen[a], owner[a]
            region = mixed(rolling.of(a, b + least) + (p - a).astype(np.uint64))
            row = np.array(long)[who]
            docs, crcs = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "crc"))
            yield from _batches([_long(grams[p]), _long(region), docs, crcs, p - begins[who], a - begins[who], b - begins[who]], _NAMES, _TYPES)

    return docs.mapInArrow(find, REGIONS)


def _with_regions(docs: DataFrame, regions: DataFrame, columns: list[str]) -> DataFrame:
    """Documents beside the list of their regions; a list is bounded by its document's length."""
    listed = regions.groupBy("doc", "crc").agg(F.collect_list(F.struct(*columns)).alias("regions"))
    listed = settle(listed, "regions-by-document")
    wanted = small_if_counted(listed.select(F.col("doc").alias("_wanted")).distinct(), BROADCAST_IDS)
    some = docs.join(wanted, F.col("doc") == F.col("_wanted"), "left_semi")
    return some.join(listed, ["doc", "crc"])


def narrower(docs: DataFrame, regions: DataFrame, least: int, step: int) -> DataFrame:
    """Split regions by the distance of their starts from the anchor, ``step`` distances each.

    All strings of a part contain a longer common stretch around the anchor; its hash
    is the part's new anchor hash. At ``step`` 1 that stretch is the string itself.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for batch in slices(batches, "text", SLICE):
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256).to_pydict()
                columns = [[] for _ in _NAMES]
                for doc, crc, text, listed in zip(rows["doc"], rows["crc"], rows["text"], rows["regions"]):
                    rolling.read(np.frombuffer((text or "").encode(), np.uint8))
                    p, a, b = (np.array([r[c] for r in listed], np.int64) for c in "pab")
                    nearest, furthest = (p - b) // step, (p - a) // step
                    count = furthest - nearest + 1
                    who = np.repeat(np.arange(len(p)), count)
                    part = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + nearest[who]
                    low, high = part * step, part * step + step - 1
                    p, a, b = p[who], np.maximum(a[who], p[who] - high), np.minimum(b[who], p[who] - low)
                    key = mixed(rolling.of(p - low, p - high + least) + low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    region = mixed(rolling.of(a, b + least) + (p - a).astype(np.uint64))
                    for column, values in zip(columns, (_long(key), _long(region), np.full(len(p), doc), np.full(len(p), crc), p, a, b)):
                        column.append(values)
                yield from _batches([np.concatenate(c) for c in columns], _NAMES, _TYPES)

    return _with_regions(docs, regions, ["p", "a", "b"]).select("doc", "crc", "text", "regions").mapInArrow(split, REGIONS)


def suffix_order(texts: list[bytes], starts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` of the joined texts, and their ranks, by ``least`` bytes.

    Prefix doubling: ranks by eight bytes, then by twice as many from pairs of ranks.
    Suffixes that agree in ``least`` bytes share a rank and stand in order of place.
    """
    joined = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    size = len(joined) - 8
    words = np.lib.stride_tricks.sliding_window_view(joined, 8)[:size]
    keys = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    ranks = np.unique(keys, return_inverse=True)[1].astype(np.uint64)
    length = 8
    while length < least:
        ahead = min(length, least - length)
        next_ranks = np.concatenate([ranks[ahead:], np.zeros(ahead, np.uint64)])
        ranks = np.unique((ranks << np.uint64(32)) | next_ranks, return_inverse=True)[1].astype(np.uint64)
        length += ahead
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    places = np.concatenate([s + o for s, o in zip(starts, offsets)])
    order = np.argsort(ranks[places], kind="stable")
    return order, ranks[places][order]


def repeated_starts(docs: DataFrame, regions: DataFrame, least: int, first_stays: bool) -> DataFrame:
    """``doc, crc, a, b``: runs of starts in these regions whose strings are in another region too.

    Regions of one anchor come together in one bucket, in document order. In the order
    of their suffixes, a start's longest previous factor reaches ``least`` bytes exactly
    if its previous smaller place, which is its neighbour among suffixes of one rank,
    is there; the next larger place likewise.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "doc", "crc", "a", "b", "bytes"]
        types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
        for batch in slices(batches, "text", SLICE):
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256).to_pydict()
                out = []
                for doc, crc, text, listed in zip(rows["doc"], rows["crc"], rows["text"], rows["regions"]):
                    raw = (text or "").encode()
                    out += [(r["h"], doc, crc, r["a"], r["b"], raw[r["a"] : r["b"] + least]) for r in listed]
                for at in range(0, len(out), 4096):
                    yield from _batches(list(zip(*out[at : at + 4096])), names, types)

    def match(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc", "crc", "a", "h")])
        # Rows of equal names bring their regions again; such copies are settled by hash.
        names = np.array([table.column(c).to_numpy() for c in ("doc", "crc", "a", "h")])
        table = table.filter(pa.array(np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(axis=0)])))
        texts = table.column("bytes").to_pylist()
        a, b, doc, crc = (table.column(c).to_numpy() for c in ("a", "b", "doc", "crc"))
        counts = b - a + 1
        order, ranks = suffix_order(texts, [np.arange(n) for n in counts], least)
        same = ranks[1:] == ranks[:-1]
        found = np.zeros(len(order), bool)
        found[order[1:][same]] = True
        if not first_stays:
            found[order[:-1][same]] = True
        owner = np.repeat(np.arange(len(a)), counts)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + a[owner]
        at = np.flatnonzero(found)
        gap = (np.diff(at) != 1) | (np.diff(owner[at]) != 0)
        head, tail = at[np.concatenate([[True], gap])] if len(at) else at, at[np.concatenate([gap, [True]])] if len(at) else at
        return pa.table({"doc": doc[owner[head]], "crc": crc[owner[head]], "a": start[head].astype(np.int32), "b": start[tail].astype(np.int32)})

    buckets = max(1, regions.count() // BUCKET_REGIONS + 1)
    pieces = _with_regions(docs, regions, ["h", "a", "b"]).select("doc", "crc", "text", "regions")
    pieces = pieces.mapInArrow(cut, "h long, doc long, crc long, a int, b int, bytes binary")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    return pieces.groupBy("bucket").applyInArrow(match, "doc long, crc long, a int, b int")


def repeated_spans(docs: DataFrame, least: int = MIN_BYTES, first_stays: bool = False) -> DataFrame:
    """``doc, crc, a, b``: runs of starts of strings that also start elsewhere (or earlier).

    1. Anchors that stand once in the corpus have no repeated string. 2. Regions that
    are equal byte for byte are settled by their hash, whatever their number. 3. The
    different regions of an anchor are put in suffix order; an anchor with more than
    GROUP_REGIONS of them is first split into narrower anchors, at last into single
    strings, so no group grows with the corpus.
    """
    rows, steps, spans = anchors(docs, least), [], []
    step = least - least // 2 + 1
    while step > 1:
        step = -(-step // 8)
        steps.append(step)
    for following in [*steps, 0]:
        # Written first, so that the join below has a shuffle of its own and can split hot anchors.
        shared = settle(rows.groupBy("h").count().where("count > 1").select("h"), "shared-hashes")
        met = settle(rows.join(shared, "h", "left_semi"), "shared-anchors")
        regions = met.groupBy("h", "rh").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "crc", "a", "p", "b")).alias("first")
        )
        regions = settle(regions.select("h", "rh", "copies", "first.*"), "regions")
        copied = regions.where("copies > 1").select("h", "rh", *[F.col(c).alias(f"_{c}") for c in ("doc", "crc", "a")])
        copies = met.join(copied, ["h", "rh"])
        if first_stays:
            copies = copies.where("NOT (doc = _doc AND crc = _crc AND a = _a)")
        spans.append(settle(copies.select("doc", "crc", "a", "b"), "copied-spans"))
        if not following:
            break
        kinds = settle(regions.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
        open_regions = settle(regions.join(kinds, "h").drop("rh", "copies"), "open-regions")
        few = open_regions.where(F.col("kinds") <= GROUP_REGIONS)
        spans.append(settle(repeated_starts(docs, few, least, first_stays), "matched-spans"))
        many = open_regions.where(F.col("kinds") > GROUP_REGIONS)
        if many.isEmpty():
            break
        rows = narrower(docs, many.drop("h", "kinds"), least, following)
    return reduce(DataFrame.union, spans)


def keyed(docs: DataFrame) -> DataFrame:
    """Name rows by id and a 64-bit hash of text and length: ``doc`` (the least long for
    null), ``crc``. Rows with one id and one text are one row to match (repeated rows)."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns(
        {
            "doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")),
            "crc": F.xxhash64(text, F.octet_length(text)),
        }
    )


def _kept(raw: bytes, starts: list[dict] | None, least: int) -> tuple[bytes, int]:
    """The bytes outside of the strings that start in these runs, and the number of runs cut out."""
    if not starts:
        return raw, 0
    edges = sorted((s["a"], s["b"] + least) for s in starts)
    parts, at, runs, last = [], 0, 0, -1
    for a, b in edges:
        if a > last:
            runs += 1
        if a > at:
            parts.append(raw[at:a])
        at, last = max(at, b), max(last, b)
    return b"".join([*parts, raw[at:]]), runs


def _with_spans(rows: DataFrame, spans: DataFrame) -> list[DataFrame]:
    """The rows beside their spans; those without spans stay where they are if the others are few."""
    listed = settle(spans.distinct().groupBy("doc", "crc").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    some = listed.select(F.col("doc").alias("_doc"), F.col("crc").alias("_crc"))
    same = (F.col("doc") == F.col("_doc")) & (F.col("crc") == F.col("_crc"))
    total = some.count()
    if total > BROADCAST_IDS:
        return [rows.join(listed, ["doc", "crc"], "left")]
    some = F.broadcast(some)
    none = F.lit(None).cast(listed.schema["spans"].dataType).alias("spans")
    return [rows.join(some, same, "left_semi").join(listed, ["doc", "crc"]), rows.join(some, same, "left_anti").select("*", none)]


def remove_repeats(docs: DataFrame, least: int = MIN_BYTES, first_stays: bool = False) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans``: every text without its repeated bytes.

    A byte goes if a string of ``least`` bytes that covers it also starts elsewhere in
    the corpus, the same text included; with ``first_stays`` only if it starts earlier,
    by doc_id, checksum and place. ``kept`` is binary, as a cut may part a character.
    Null and empty texts keep nothing; repeated rows are copies of each other; rows
    without an id come first; an empty table gives no rows; other columns are not
    looked at.
    """
    rows = keyed(docs.select("doc_id", "text")).withColumn("doc_id", F.col("doc_id").cast("long"))
    spans = repeated_spans(rows.select("doc", "crc", "text"), least, first_stays)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            texts = _binary(batch.column("text"))
            kept = [_kept(t, s, least) for t, s in zip(texts, batch.column("spans").to_pylist())]
            sizes = np.array([len(t) for t in texts], np.int64)
            left = np.array([len(k) for k, _ in kept], np.int64)
            columns = [batch.column("doc_id"), pa.array([k for k, _ in kept], pa.binary()), pa.array(sizes), pa.array(sizes - left), pa.array([n for _, n in kept], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"
    parts = [p.select("doc_id", "text", "spans").mapInArrow(cut, schema) for p in _with_spans(rows, spans)]
    return reduce(DataFrame.union, parts)


def without_repeats(docs: DataFrame, least: int, first_stays: bool = True) -> DataFrame:
    """The rows of ``docs`` with repeated stretches cut out of ``text``, other columns as they were.

    Parts of characters at a cut go with it. A text that is gone whole becomes empty.
    """
    names = docs.columns
    rows = keyed(docs.select(F.struct("*").alias("row"), "doc_id", "text")).drop("doc_id")
    spans = repeated_spans(rows.select("doc", "crc", "text"), least, first_stays)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            listed = batch.column("spans").to_pylist()
            fresh = [t and _kept(t, s, least)[0].decode("utf-8", "ignore") for t, s in zip(texts, listed)]
            fresh = [t.decode() if isinstance(t, bytes) else t for t in fresh]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fresh, pa.string())], names=["row", "text"])

    parts = [p.select("row", "text", "spans") for p in _with_spans(rows, spans)]
    schema = rows.select("row", "text").schema
    cleaned = reduce(DataFrame.union, [p.mapInArrow(cut, schema) for p in parts])
    return cleaned.select(*[F.col("text").alias(n) if n == "text" else F.col("row").getField(n).alias(n) for n in names])


def repeat_digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
