"""Chat formatting with loss masks from token offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows

# The template: <s>[INST] role [/INST]text</s> for every turn.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
_CONTROL = r"(/?s>|/?INST\]|\|endoftext\|>)"
_PLAIN = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)

FORMATTED = (
    "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"
)


def escape(text: str) -> str:
    """Put a backslash into control strings, and one more into strings that look escaped."""
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation in the template, and where the assistant's texts lie in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST] {escape(role)} [/INST]", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def masked_texts(formatted: str, starts, ends, mask) -> list[str]:
    """The unescaped runs of text under the mask; a control string ends a run."""
    import numpy as np

    mask = np.asarray(mask, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in edges.reshape(-1, 2)]


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation: its text in the template, token ids with offsets, loss mask.

    The whole conversation is rendered and encoded once. Control strings are tokens
    of their own, so no token crosses a turn's border; the assistant's spans are
    sorted, and a binary search over the token starts finds the tokens under each.
    Turns are ordered by turn, role and text; null roles and texts count as empty;
    a null ``conv_id`` is a conversation of its own; repeated rows stay; an empty
    table gives no rows; other columns are not looked at. A conversation is one row
    of the result, so it is held whole by one task.
    """
    grouped = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.struct(
                F.col("turn"),
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            ).alias("said"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("said")).alias("said"))
        .select("conv_id", F.col("said.role").alias("roles"), F.col("said.text").alias("texts"))
    )
    schema = arrow_rows(FORMATTED)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import AddedToken, Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64).to_pydict()
                rendered = [render(list(zip(*x))) for x in zip(part["roles"], part["texts"])]
                rows = []
                for (text, spans), coded in zip(
                    rendered, model.encode_batch([x[0] for x in rendered], add_special_tokens=False)
                ):
                    offsets = np.array(coded.offsets, np.int32).reshape(-1, 2)
                    change = np.zeros(len(offsets) + 1, np.int8)
                    if spans:
                        bounds = np.searchsorted(offsets[:, 0], np.array(spans))
                        np.add.at(change, bounds[:, 0], 1)
                        np.add.at(change, bounds[:, 1], -1)
                    rows.append((coded.ids, offsets[:, 0], offsets[:, 1], np.cumsum(change[:-1]) > 0))
                ids, starts, ends, masks = zip(*rows)
                columns = [part["conv_id"], [x[0] for x in rendered], ids, starts, ends, masks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                )

    return grouped.mapInArrow(encode, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and hashes."""
    schema = arrow_rows(DIGESTS)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                rows = []
                for conv, text, starts, ends, mask in zip(*batch.slice(first, 64).to_pydict().values()):
                    turns = parse(text)
                    loss = "".join(masked_texts(text, starts, ends, mask))
                    said = "".join(f"{role}\n{words}\n" for role, words in turns)
                    rows.append((conv, len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    return formatted.select("conv_id", "formatted", "starts", "ends", "loss_mask").mapInArrow(digest, DIGESTS)
