"""Packing by non-negative least squares over shallow length combinations."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, place_within, slices
from newsloom.runtime import BROADCAST_IDS, settle, small_if_counted

WINDOW = 2048
END_ID = 1
# Distinct words whose ids a task keeps; a full table starts anew.
TABLE_WORDS = 600_000

# Chunks that the model's normaliser only lower-cases and whose words a pattern finds:
# letters below U+0250 (but the dotted capital I), digits, and ASCII marks other than
# the apostrophe and the signs of control tokens; the lower-cased chunk must be such too.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"
_MARKS = re.escape('!"#$%&()*+,-./:;=?@[\\]^_`{}~')
_SIMPLE = re.compile(f"[{_LETTERS}0-9{_MARKS}]+")
_WORD = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


class WordIds(dict):
    """Ids of white-space separated chunks, each distinct one encoded when it is first met.

    The model drops white space, so a text's ids are those of its chunks in turn.
    Plain chunks go word by word through the model, all others through the library.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.symbols = self._byte_symbols()
        self.words: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not (_SIMPLE.fullmatch(text) and _SIMPLE.fullmatch(text.lower())):
            ids = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        elif text.isalpha():
            ids = self._word(text.lower())
        else:
            ids = b"".join([self.words.get(w) or self._word(w) for w in _WORD.findall(text.lower())])
        self[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            shown = word if word.isascii() else "".join([self.symbols[b] for b in word.encode()])
            known = self.words[word] = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
        return known

    def _byte_symbols(self) -> dict[int, str]:
        """The character that stands for each byte: its own if visible, else the next from U+0100."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, END_ID after them."""
        if len(self) > TABLE_WORDS:
            self.clear()
            self.words.clear()
        find, end = self.__getitem__, array("I", [END_ID]).tobytes()
        # The model lowers all letters; only control tokens must keep theirs until then.
        return [b"".join(map(find, (t if b"<|" in t else t.lower()).split())) + end for t in texts]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


@dataclass
class Plan:
    """Combinations of lengths, how often each is used, and how many of each length are left over."""

    combinations: list[tuple[tuple[int, ...], int]]
    left: np.ndarray
    window: int = WINDOW

    def sequences(self) -> int:
        return sum(count for _, count in self.combinations)

    def slots(self) -> np.ndarray:
        """Rows (length, first place, end place, first sequence, offset).

        Piece number ``first place + i`` of a length goes to sequence ``first sequence + i``.
        """
        rows, place, sequence = [], [0] * (self.window + 1), 0
        for lengths, count in self.combinations:
            offset = 0
            for length in lengths:
                rows.append((length, place[length], place[length] + count, sequence, offset))
                place[length] += count
                offset += length
            sequence += count
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def combinations_of(window: int) -> np.ndarray:
    """All sets of two or three lengths that fill the window exactly."""
    a = np.arange(window // 3 + 1)
    b = np.arange(window // 2 + 1)
    first, second = np.meshgrid(a, b, indexing="ij")
    first, second = first.ravel(), second.ravel()
    third = window - first - second
    keep = (second >= np.maximum(first, 1)) & (third >= second)
    return np.stack([first, second, third], axis=1)[keep]


def solve_plan(histogram: np.ndarray, window: int = WINDOW, rounds: int = 100, least_fill: float = 0.98) -> Plan:
    """Repeat counts of the combinations that come nearest to the histogram, as whole numbers.

    Non-negative least squares by accelerated projected gradient steps, rounded down,
    then every combination in turn raised as far as the lengths left over allow. What
    remains is packed greedily, the longest first, into windows filled to ``least_fill``
    at least; lengths that find no such window are left over.
    """
    combos = combinations_of(window)
    used = np.minimum(histogram[combos] + (combos == 0), 1).all(axis=1)
    combos = combos[used]
    target = histogram.astype(float).copy()
    target[0] = 0
    weight = 1 / np.sqrt(np.maximum(target, 1))
    weight[0] = 0
    x = before = np.zeros(len(combos))
    loads = np.bincount(combos.ravel(), minlength=window + 1).astype(float)
    # Rows of the matrix meet many combinations: scale each step by how many share its lengths.
    scale = 1 / np.maximum((loads * weight**2)[combos].max(axis=1, initial=1e-12) * 3, 1e-12) if len(combos) else x
    for turn in range(rounds if len(combos) else 0):
        ahead = x + turn / (turn + 3) * (x - before)
        made = np.bincount(combos.ravel(), np.repeat(ahead, 3), minlength=window + 1)
        gap = weight**2 * (target - made)
        before, x = x, np.maximum(ahead + scale * gap[combos].sum(axis=1), 0)
    left = histogram.astype(np.int64).copy()
    left[0] = np.iinfo(np.int64).max // 4
    counts = np.zeros(len(combos), np.int64)
    order = np.argsort(-x, kind="stable")
    rest, triples = left.tolist(), combos.tolist()
    for raised in (False, True):
        for c in order.tolist():
            a, b, d = triples[c]
            fit = min(rest[n] // ((n == a) + (n == b) + (n == d)) for n in (a, b, d))
            if not raised:
                fit = min(fit, int(x[c]))
            if fit > 0:
                counts[c] += fit
                for length in (a, b, d):
                    rest[length] -= fit
    chosen = [(tuple(n for n in combos[c].tolist() if n), int(counts[c])) for c in np.flatnonzero(counts)]
    rest[0] = 0
    over = np.zeros(window + 1, np.int64)
    longest = window
    while longest:
        if not rest[longest]:
            longest -= 1
            continue
        pattern, room, length = [longest], window - longest, longest
        while room:
            length = min(length, room)
            spare = rest[length] - pattern.count(length) if rest[length] else 0
            if spare > 0:
                more = min(spare, room // length)
                pattern += [length] * more
                room -= more * length
            length -= 1
            if not length:
                break
        if window - room < least_fill * window:
            over[longest], rest[longest] = rest[longest], 0
            continue
        times = min(rest[n] // pattern.count(n) for n in set(pattern))
        for n in pattern:
            rest[n] -= times
        chosen.append((tuple(pattern), times))
    return Plan(chosen, over, window)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _place_pieces(rows: DataFrame, plan: Plan, first_full: int) -> DataFrame:
    """Give the pieces of each document their sequence and offset.

    Everything follows from a remainder's length and its number among those of that
    length: the combination's sequence while combinations last, then a position in
    the line of what is left over, which is cut at every window.
    """
    window = plan.window
    slots = plan.slots()
    keys = (slots[:, 0] << 42) + slots[:, 1]
    taken = np.bincount(slots[:, 0], slots[:, 2] - slots[:, 1], minlength=window + 1).astype(np.int64)
    sequences = plan.sequences()
    lengths = np.arange(window + 1)
    line_start = np.concatenate([[0], np.cumsum(plan.left * lengths)])
    total = int(line_start[window + 1])
    # The line's last stretch is cut into powers of two, which need no padding.
    tail, size, cuts = total // window * window, window, []
    while tail < total:
        size //= 2
        if total - tail >= size:
            cuts.append(tail)
            tail += size
    cuts = np.array([*cuts, total] if cuts else [total], np.int64)
    schema = arrow_rows(f"{PIECES}, n long, tag long, cut boolean")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, full, rest = row["n"], row["n"] // window, row["n"] % window
                head = row["full_start"] or 0
                out += [
                    (row["doc_id"], k * window, window, row["crcs"][k], n, first_full + head + k, 0, n, row["tag"], False)
                    for k in range(full)
                ]
                if not rest:
                    continue
                place, start = row["place"], full * window
                if place < taken[rest]:
                    s = slots[np.searchsorted(keys, (rest << 42) + place, "right") - 1]
                    out.append((row["doc_id"], start, rest, row["crcs"][full], n, int(s[3] + place - s[1]), int(s[4]), n, row["tag"], False))
                    continue
                at = int(line_start[rest] + (place - taken[rest]) * rest)
                end = at + rest
                whole = True
                while at < end:
                    if at < cuts[0]:
                        begin, stop = at // window * window, min(at // window * window + window, int(cuts[0]))
                        number = at // window
                    else:
                        k = int(np.searchsorted(cuts, at, "right"))
                        begin, stop = int(cuts[k - 1]), int(cuts[k])
                        number = int(cuts[0]) // window + k - 1
                    length = min(end, stop) - at
                    whole = whole and length == rest
                    out.append((row["doc_id"], start, length, row["crcs"][full] if whole else None, n, sequences + number, at - begin, n, row["tag"], not whole))
                    start, at = start + length, at + length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema
            )

    return rows.mapInArrow(place, f"{PIECES}, n long, tag long, cut boolean")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids, one row for each piece.

    A document's full windows are sequences of their own. Remainders are combined by
    the plan, which fills windows to 98 % at least; what it leaves over is laid end to
    end and cut at every window, and the end of that line at powers of two.

    A null or empty text is its end id alone; repeated rows are documents of their
    own; an empty table gives no rows; other columns are not looked at. The driver
    holds the histogram of ``window`` lengths and the plan, however many the rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = settle(token_ids(texts, tokenizer, window, keep=False), "token-counts")
    rows = counted.select(
        "*",
        F.xxhash64("crcs").alias("tag"),
        F.expr(f"n % {window}").alias("rest"),
        F.expr(f"n div {window}").alias("full"),
    )
    histogram = np.zeros(window + 1, np.int64)
    for rest, count in rows.where("rest > 0").groupBy("rest").count().collect():
        histogram[rest] = count
    plan = solve_plan(histogram, window)
    over = int((plan.left * np.arange(window + 1)).sum())
    first_full = plan.sequences() + over // window + bin(over % window).count("1")

    order = ["doc_id", "n", "tag"]
    numbered = place_within(rows, ["rest"], order, "place")
    numbered = place_within(numbered, ["full"], order, "full_place")
    # One row for each number of full windows.
    sizes = rows.groupBy("full").agg((F.count(F.lit(1)) * F.col("full")).alias("_windows"))
    earlier = Window.orderBy("full").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("full", F.coalesce(F.sum("_windows").over(earlier), F.lit(0)).alias("_start"))
    numbered = numbered.join(sizes, "full").withColumn("full_start", F.expr("_start + full_place * full"))
    pieces = settle(
        _place_pieces(numbered.select("doc_id", "n", "tag", "crcs", "place", "full_start"), plan, first_full), "pieces"
    )
    names = [c.split()[0] for c in PIECES.split(", ")]
    cut = pieces.where("cut")
    wanted = cut.select("doc_id").distinct()
    again = texts.join(small_if_counted(wanted, BROADCAST_IDS).withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    ids = token_ids(again, tokenizer, window).select("doc_id", "n", F.xxhash64("crcs").alias("tag"), "ids").dropDuplicates(order)
    ids = ids.select(*[F.col(c).alias(f"_{c}") for c in ids.columns])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("n") == F.col("_n")) & (F.col("tag") == F.col("_tag"))
    stretch = F.expr("substring(_ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    mended = cut.join(ids, same).withColumn("ids_crc32", F.crc32(stretch))
    return pieces.where("NOT cut").select(*names).union(mended.select(*names))


def token_ids(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep: bool = True) -> DataFrame:
    """``doc_id, n, crcs, ids``: number of ids, checksum of each window of them, the ids.

    Ids are little-endian 32-bit numbers, the end id last; null unless ``keep``.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        from zlib import crc32

        gc.disable()  # the tables hold many small objects and no cycles
        model = WordIds(tokenizer)
        for batch in slices(batches, "text", 4 << 20):
            coded = model.encode(_texts(batch))
            step = 4 * window
            crcs = [[crc32(c[i : i + step]) for i in range(0, len(c), step)] for c in coded]
            columns = [
                batch.column("doc_id"),
                pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array(crcs, pa.list_(pa.int64())),
                pa.array(coded if keep else [None] * len(coded), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "crcs", "ids"])

    return docs.mapInArrow(encode, "doc_id long, n long, crcs array<long>, ids binary")
