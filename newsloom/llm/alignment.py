"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which overlap.

Coarse cuts come from the libraries' own spans: character offsets of ``tokenizers`` and
the byte spans of sentencepiece's proto. Several tokens inside one coarse span (a
character cut into bytes, byte-fallback pieces) are refined with the lengths of their
decoded bytes. A task cuts texts into chunks, encodes many distinct ones as one text and
aligns them with numpy, by the tokens' decoded lengths; Spark counts the id pairs over
the corpus and brings the counts back to the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import slices
from newsloom.runtime import settle, small

# Rows of the corpus-wide id-pair table that may be broadcast (four longs each, some 40 MB).
BROADCAST_PAIRS = 1_000_000
PAIRS = "pairs array<struct<a:int,b:int,m:int>>"
ALIGNED = (
    f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {PAIRS}"
)
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_level_alphabet() -> dict[str, int]:
    """The byte-level BPE's characters for bytes: printable Latin-1 stands for itself,
    every other byte for 256 and up, in byte order (the rule of the scheme)."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    extra = iter(range(256, 512))
    return {chr(b if b in kept else next(extra)): b for b in range(256)}


class Tables:
    """Byte strings of every id of both tokenizers, as one flat array with starts and lengths."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        # Tasks run side by side already; library threads would only add CPU time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_level_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            hit = BYTE_PIECE.fullmatch(piece) if self.b.is_byte(i) else None
            b_bytes.append(bytes([int(hit[1], 16)]) if hit else piece.replace("▁", " ").encode())
        self.a_flat, self.a_start, self.a_len = self._flat(a_bytes)
        self.b_flat, self.b_start, self.b_len = self._flat(b_bytes)

    @staticmethod
    def _flat(strings: list[bytes]):
        lengths = np.array([len(s) for s in strings], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.frombuffer(b"".join(strings), np.uint8), starts, lengths


@cache
def tables(a_path: str, b_path: str) -> Tables:
    """Loaded once per Python worker."""
    return Tables(a_path, b_path)


def _joined(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bytes of the tokens, one after the other."""
    size = lengths[ids]
    ends = np.cumsum(size)
    place = np.repeat(starts[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return flat[place]


def refined_ends(coarse_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from the byte starts of their coarse spans and their own lengths.

    A token that starts a new coarse span starts where the span does; one that shares
    its span's start with the tokens before it follows them by their decoded lengths.
    """
    if not len(size):
        return np.zeros(0, np.int64)
    fresh = np.concatenate([[True], coarse_start[1:] != coarse_start[:-1]])
    first = np.flatnonzero(fresh)
    span = np.cumsum(fresh) - 1
    total = np.cumsum(size)
    before = total[first] - size[first]
    return coarse_start[first][span] + total - before[span]


def _utf8_starts(text: str) -> np.ndarray:
    """Byte offset of every code point of the text, and the length at the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(width)])


def align(text: str, t: Tables, enc=None, proto=None) -> tuple | None:
    """``(a_ids, b_ids, a_ends, b_ends)`` in bytes of space+text, or None when either
    tokenizer's bytes do not join to space+text (or the text is empty). ``enc`` and
    ``proto`` are the libraries' encodings when they were made before."""
    if not text:
        return None
    target = np.frombuffer((" " + text).encode("utf-8", "surrogatepass"), np.uint8)
    enc = t.a.encode(" " + text, add_special_tokens=False) if enc is None else enc
    a_ids = np.array(enc.ids, np.int64)
    proto = t.b.encode(text, return_type="proto") if proto is None else proto
    spans = [(p.id, p.begin, p.end) for p in proto.pieces]
    b_ids = np.array([s[0] for s in spans], np.int64)
    for flat, starts, lengths, ids in ((t.a_flat, t.a_start, t.a_len, a_ids), (t.b_flat, t.b_start, t.b_len, b_ids)):
        got = _joined(flat, starts, lengths, ids)
        if len(got) != len(target) or not np.array_equal(got, target):
            return None
    # Coarse cuts in bytes of space+text: characters to bytes for A, the proto's spans for B
    # (moved by the space B puts first; its first piece starts at 0).
    char_bytes = _utf8_starts(" " + text)
    a_coarse = char_bytes[np.array([o[0] for o in enc.offsets], np.int64)]
    b_coarse = np.array([s[1] + 1 for s in spans], np.int64)
    b_coarse[0] = 0
    a_ends, b_ends = refined_ends(a_coarse, t.a_len[a_ids]), refined_ends(b_coarse, t.b_len[b_ids])
    exact_a, exact_b = np.cumsum(t.a_len[a_ids]), np.cumsum(t.b_len[b_ids])
    # The cuts must agree with the decoded lengths; where a library's span is off, the lengths decide.
    return a_ids, b_ids, (a_ends if np.array_equal(a_ends, exact_a) else exact_a), (b_ends if np.array_equal(b_ends, exact_b) else exact_b)


def describe(text: str | None, t: Tables) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
    """Counts, the hash of the groups, and the distinct linked id-pair keys (a * 65536 + b)
    with their multiplicity, from the whole text at once: what ``describe_chunked`` must give."""
    found = align(text or "", t)
    if found is None:
        return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_ids, b_ids, a_ends, b_ends = found
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    # Tokens in text order within each group, A before B: "a1,a2|b1;a3|b2,b3".
    side = np.concatenate([2 * np.searchsorted(common, a_ends, "left"), 2 * np.searchsorted(common, b_ends, "left") + 1])
    order = np.argsort(side, kind="stable")
    key = side[order]
    after = np.concatenate([key[1:], [-1]])
    marks = np.where(after == key, ",", np.where(key % 2 == 0, "|", ";"))
    marks[-1] = ""
    shown = np.empty(2 * len(key), object)
    shown[0::2] = np.concatenate([a_ids, b_ids]).astype(str)[order]
    shown[1::2] = marks
    bounds = np.union1d(a_ends, b_ends)
    a_of, b_of = np.searchsorted(a_ends, bounds, "left"), np.searchsorted(b_ends, bounds, "left")
    keys, counts = np.unique(a_ids[a_of] * 65536 + b_ids[b_of], return_counts=True)
    digest = hashlib.sha256("".join(shown).encode()).hexdigest()
    return len(a_ids), len(b_ids), len(common), len(bounds), digest, keys, counts


# Where both tokenizers must cut: before a space between two characters outside Unicode
# white space (fixed values: the White_Space property). A space after white space is
# not a cut: sentencepiece may keep a run of blanks in one piece.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(f"(?<=[^{_BLANKS}]) (?=[^{_BLANKS}])")
BLANK_END = re.compile(f"\\A[{_BLANKS}]|[{_BLANKS}]\\Z")
# Chunks that are encoded as one text, and how few are encoded one by one when that fails.
JOINED, FEW = 4096, 8
# Bytes a task's table of aligned chunks may hold; a full table starts anew.
TABLE_BYTES = 64 << 20


def _ends(coarse: list[int], sizes: list[int]) -> list[int]:
    """``refined_ends`` for the few tokens of a chunk."""
    ends, at = [], 0
    for k, (start, n) in enumerate(zip(coarse, sizes)):
        at = (start if k == 0 or start != coarse[k - 1] else at) + n
        ends.append(at)
    return ends


class ChunkTable(dict):
    """Alignments of distinct chunks of text, each made once per task.

    Neither tokenizer lets a token cross a cut of ``CUT``: there the byte-level
    pre-tokenizer starts a word with its space and sentencepiece starts a piece with
    U+2581 (a test compares chunked and whole texts on random texts). So a text's tokens are those of its chunks in turn, each chunk encoded as
    space+chunk (A) and chunk (B, whose added space stands for the cut one).
    """

    def __init__(self, t: Tables) -> None:
        super().__init__()
        self.t, self.held = t, 0
        self.a_bytes = [t.a_flat[a : a + n].tobytes() for a, n in zip(t.a_start.tolist(), t.a_len.tolist())]
        self.b_bytes = [t.b_flat[a : a + n].tobytes() for a, n in zip(t.b_start.tolist(), t.b_len.tolist())]
        self.said = np.array([str(i) for i in range(max(len(t.a_len), len(t.b_len)))], object)

    def fill(self, chunks: set[str]) -> None:
        missing = [c for c in chunks if c not in self]
        if self.held > TABLE_BYTES:
            self.clear()
            self.held, missing = 0, list(chunks)
        # A blank at the end of a chunk could run together with the space between two chunks, and
        # U+2581 with it; chunks of plain letters are kept apart, as they never fail.
        plain, odd, alone = [], [], []
        for c in missing:
            joins = c and "▁" not in c and not BLANK_END.search(c)
            (alone if not joins else plain if c.isascii() and c.isprintable() else odd).append(c)
        for group in (plain, odd):
            for at in range(0, len(group), JOINED):
                self._fill_joined(group[at : at + JOINED])
        for at in range(0, len(alone), JOINED):
            self._fill_alone(alone[at : at + JOINED])

    def _keep(self, chunk: str, found: tuple | None) -> None:
        self[chunk] = found
        self.held += 2 * len(chunk) + 120 + (0 if found is None else 8 * len(found[5]) + len(found[4]))

    def _fill_alone(self, part: list[str]) -> None:
        encs = self.t.a.encode_batch([" " + c for c in part], add_special_tokens=False)
        protos = self.t.b.encode(part, return_type="proto", num_threads=1)
        for chunk, enc, proto in zip(part, encs, protos):
            self._keep(chunk, self._align(chunk, enc, proto))

    def _fill_joined(self, part: list[str]) -> None:
        """Encode the chunks as one text, which has a cut between any two, and align all at once;
        a text that is not given back byte for byte is tried in halves."""
        found = self._align_joined(part)
        if found is not None:
            for chunk, one in zip(part, found):
                self._keep(chunk, one)
        elif len(part) <= FEW:
            self._fill_alone(part)
        else:
            self._fill_joined(part[: len(part) // 2])
            self._fill_joined(part[len(part) // 2 :])

    def _align_joined(self, part: list[str]) -> list[tuple] | None:
        t, text = self.t, " ".join(part)
        a_ids = np.array(t.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        b_ids = np.array(t.b.encode(text), np.int64)
        target = np.frombuffer((" " + text).encode("utf-8", "surrogatepass"), np.uint8)
        sizes = [len(c) if c.isascii() else len(c.encode("utf-8", "surrogatepass")) for c in part]
        cuts = np.cumsum(np.array(sizes, np.int64) + 1)
        a_ends, b_ends = np.cumsum(t.a_len[a_ids]), np.cumsum(t.b_len[b_ids])
        for flat, starts, lengths, ids, ends in (
            (t.a_flat, t.a_start, t.a_len, a_ids, a_ends), (t.b_flat, t.b_start, t.b_len, b_ids, b_ends)
        ):
            if not len(ends) or ends[-1] != len(target) or not np.array_equal(_joined(flat, starts, lengths, ids), target):
                return None
            if not np.array_equal(ends[np.searchsorted(ends, cuts)], cuts):
                return None
        bounds = np.union1d(a_ends, b_ends)
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        keys = a_ids[np.searchsorted(a_ends, bounds)] * 65536 + b_ids[np.searchsorted(b_ends, bounds)]
        # Tokens in text order within each group, A before B; a line for each chunk.
        side = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        last = np.flatnonzero(np.append(side[1:] != side[:-1], True))
        marks = np.full(len(side), ",", object)
        marks[last] = np.where(side[last] % 2 == 0, "|", ";")
        upto = np.searchsorted(common, cuts, "right")
        marks[last[2 * upto - 1]] = "\n"
        shown = np.empty(2 * len(side), object)
        shown[0::2] = self.said[np.concatenate([a_ids, b_ids])[order]]
        shown[1::2] = marks
        lines = "".join(shown.tolist()).split("\n")
        link_ends = np.searchsorted(bounds, cuts, "right")
        counts = [np.diff(e, prepend=0).tolist() for e in (
            np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right"), upto, link_ends)]
        parts = np.split(keys, link_ends[:-1])
        return list(zip(*counts, lines, parts))

    def _align(self, chunk: str, enc, proto):
        target = (" " + chunk).encode("utf-8", "surrogatepass")
        a_ids = enc.ids
        pieces = [(p.id, p.begin) for p in proto.pieces]
        b_ids = [p[0] for p in pieces]
        if b"".join([self.a_bytes[i] for i in a_ids]) != target or b"".join([self.b_bytes[i] for i in b_ids]) != target:
            return None
        if chunk.isascii():
            a_coarse = [o[0] for o in enc.offsets]
        else:
            starts = [0]
            for c in " " + chunk:
                starts.append(starts[-1] + len(c.encode("utf-8", "surrogatepass")))
            a_coarse = [starts[o[0]] for o in enc.offsets]
        b_coarse = [0] + [p[1] + 1 for p in pieces[1:]]
        a_sizes = [len(self.a_bytes[i]) for i in a_ids]
        b_sizes = [len(self.b_bytes[i]) for i in b_ids]
        a_ends, b_ends = _ends(a_coarse, a_sizes), _ends(b_coarse, b_sizes)
        if a_ends != list(accumulate(a_sizes)):
            a_ends = list(accumulate(a_sizes))
        if b_ends != list(accumulate(b_sizes)):
            b_ends = list(accumulate(b_sizes))
        groups, keys, i, j, a_from, b_from = [], [], 0, 0, 0, 0
        while i < len(a_ends) and j < len(b_ends):
            keys.append(a_ids[i] * 65536 + b_ids[j])
            if a_ends[i] == b_ends[j]:
                groups.append(",".join(map(str, a_ids[a_from : i + 1])) + "|" + ",".join(map(str, b_ids[b_from : j + 1])))
                i, j, a_from, b_from = i + 1, j + 1, i + 1, j + 1
            elif a_ends[i] < b_ends[j]:
                i += 1
            else:
                j += 1
        return len(a_ids), len(b_ids), len(groups), len(keys), ";".join(groups), np.array(keys, np.int64)


def describe_chunked(text: str | None, table: ChunkTable, chunks: list[str] | None = None) -> tuple:
    """``describe`` from the chunks of the text, which ``table`` must hold; ``chunks`` when it was cut before."""
    parts = [table[c] for c in (CUT.split(text) if chunks is None else chunks)] if text else [None]
    if any(p is None for p in parts):
        return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_a, n_b, n_groups, n_links, groups, keys = zip(*parts)
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    return sum(n_a), sum(n_b), sum(n_groups), sum(n_links), digest, keys, counts


def aligned_rows(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document row, numbered, with its alignment (see ``alignment_digests``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(a_path, b_path)
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")],
                            ("groups_sha256", pa.string()),
                            ("pairs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int32())])))])
        pair = schema.field("pairs").type
        table = ChunkTable(t)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            chunks = [CUT.split(text) if text else [] for text in texts]
            table.fill({c for cut in chunks for c in cut})
            out = [describe_chunked(text, table, cut) for text, cut in zip(texts, chunks)]
            keys = np.concatenate([np.zeros(0, np.int64), *[o[5] for o in out]])
            offsets = np.concatenate([[0], np.cumsum([len(o[5]) for o in out])]).astype(np.int32)
            items = pa.StructArray.from_arrays(
                [pa.array((keys >> 16).astype(np.int32)), pa.array((keys & 65535).astype(np.int32)),
                 pa.array(np.concatenate([np.zeros(0, np.int64), *[o[6] for o in out]]).astype(np.int32))],
                fields=list(pair.value_type),
            )
            columns = [batch.column("row"), batch.column("doc_id"), *[pa.array([o[k] for o in out], pa.int64()) for k in range(4)],
                       pa.array([o[4] for o in out], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), items, type=pair)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ALIGNED)


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per document row.

    A is ``a_path`` (tokenizers) over space+text, B is ``b_path`` (sentencepiece) over the
    text; strings of special tokens are plain text. A pair's count is the number of
    document rows (repeated rows each count) that link it; ``n_best`` counts the links
    whose count is the highest of their A id, ties included. Null, empty and texts that
    either tokenizer does not give back byte for byte have zeros and ``''``. An empty
    table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    aligned = settle(aligned_rows(docs, a_path, b_path), "aligned")
    links = aligned.select("row", F.explode("pairs").alias("p")).select("row", "p.a", "p.b", "p.m")
    counts = links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"))
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    scored = settle(counts.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best")), "pair-counts")
    sums = (
        links.join(small(scored, scored.count(), BROADCAST_PAIRS), ["a", "b"])
        .groupBy("row")
        .agg(
            F.sum(F.col("m") * F.col("docs")).alias("count_sum"),
            F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"),
        )
    )
    return aligned.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
