"""SentencePiece encoding and decoding through tables of distinct chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import slices

MARK = "▁"
# Distinct chunks that a task's table may hold; a full table starts anew.
TABLE_CHUNKS = 400_000
_MARKED = re.compile(rb" +[^ ]*")


def load(model: str):
    """The processor, after checking that a text can be cut before every marked word.

    That holds when no piece has a mark after another character, a mark is put
    before the text, and the model neither changes nor removes characters.
    """
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=model)
    for number in range(processor.get_piece_size()):
        if MARK in processor.id_to_piece(number).lstrip(MARK):
            raise ValueError(f"piece {number} crosses a whitespace marker")
    for probe in (" a", "a  b ", "a\tb", "ﬁ", "́ a"):
        if processor.decode(processor.encode(probe)) != probe:
            raise ValueError("the model changes texts, so marked words are not its chunks")
    return processor


class ChunkTable:
    """Distinct chunks, each worked out once, and their results back to back."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.values = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def add(self, chunks: list[bytes], results: list[list[int]]) -> None:
        first = len(self.places)
        self.places.update(zip(chunks, range(first, first + len(chunks))))
        sizes = np.fromiter(map(len, results), np.int64, len(results))
        flat = np.fromiter(chain.from_iterable(results), np.int32, int(sizes.sum()))
        self.values = np.concatenate([self.values, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def join(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Results of the chunks in their order, and where each chunk's result ends."""
        at = np.fromiter(map(self.places.__getitem__, chunks), np.int64, len(chunks))
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        shift = np.repeat(begin - (ends - size), size)
        return self.values[shift + np.arange(len(shift))], ends


def marked_words(text: bytes) -> list[bytes]:
    """The text cut before every run of markers; the model's own first marker included."""
    return _MARKED.findall(b" " + text.replace(MARK.encode(), b" ")) if text else []


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, exactly as the library gives them.

    Pieces cannot cross a whitespace marker, so each task segments a distinct marked
    word once and joins its ids back by position. The tables stay inside the tasks:
    one for the corpus would need every occurrence of every word in a shuffle. Null
    and empty texts have no ids; a text without white space is one chunk; repeated
    rows get equal ids; an empty table gives no rows; other columns are not looked at.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, table = load(model), ChunkTable()
        lone = processor.encode("a ")[len(processor.encode("a")) :]  # a marker with nothing after it
        for batch in slices(batches, "text"):
            if len(table.places) > TABLE_CHUNKS:
                table = ChunkTable()
            chunks: list[bytes] = []
            last = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                chunks += marked_words(text or b"")
                last.append(len(chunks))
            new = list(set(chunks).difference(table.places))
            coded = processor.encode([c[1:].decode() for c in new], num_threads=1)
            table.add(new, [ids or lone for ids in coded])
            ids, ends = table.join(chunks)
            bounds = np.concatenate([[0], ends])[[0, *last]]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def surfaces(processor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of the pieces back to back, where each begins, and which ids stand for text."""
    size = processor.get_piece_size()
    parts, plain = [], np.ones(size, bool)
    for number in range(size):
        piece = processor.id_to_piece(number)
        if processor.is_byte(number):
            parts.append(bytes([int(piece[3:5], 16)]))
        else:
            plain[number] = not (processor.is_unknown(number) or processor.is_control(number) or processor.is_unused(number))
            parts.append(piece.replace(MARK, " ").encode())
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.frombuffer(b"".join(parts), np.uint8), starts, plain


def decode_pieces(coded: DataFrame, model: str) -> DataFrame:
    """Add the column ``decoded``: the text of each row's ``ids``, as the library decodes them.

    The pieces' bytes are joined by position; a leading marker is the one that encoding
    put there and goes. Rows with ids that stand for no text, or whose bytes are not
    UTF-8, are decoded by the library. A null list gives an empty text.
    """
    import pyarrow.compute as pc

    schema = coded.select("*", F.lit("").alias("decoded")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model)
        values, starts, plain = surfaces(processor)
        for batch in slices(batches, "ids", 1 << 20):
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            lengths = starts[ids + 1] - starts[ids]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            shift = np.repeat(starts[ids] - ends[:-1], lengths)
            joined = values[shift + np.arange(len(shift))].tobytes()
            odd = np.concatenate([[0], np.cumsum(~plain[ids])])[at]
            decoded = []
            for a, b, begin, end, strange in zip(at, at[1:], ends[at], ends[at[1:]], np.diff(odd)):
                try:
                    text = joined[begin + (joined[begin : begin + 1] == b" ") : end].decode()
                except UnicodeDecodeError:
                    strange = True
                decoded.append(processor.decode(ids[a:b].tolist()) if strange else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(decode, schema)


def piece_digests(decoded: DataFrame) -> DataFrame:
    """Number of ids, and hashes of the ids and of the decoded text."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
