"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import place_within


def jump_shards(key: Column, shards: int) -> Column:
    """Shard of a key among ``shards`` and among one more: ``struct<shard, grown_shard>``.

    The key's hash seeds a generator whose draws are the shard counts at which the
    key would move; the last one below the count is its shard. So one more shard
    takes keys only into itself. Equal keys, null among them, share a shard.
    """

    @F.pandas_udf("shard int, grown_shard int")
    def jump(hashes: pd.Series) -> pd.DataFrame:
        import numpy as np

        state = hashes.to_numpy().astype(np.int64).view(np.uint64).copy()
        shard = np.zeros(len(state), np.int64)
        grown = np.zeros(len(state), np.int64)
        ahead = np.zeros(len(state), np.int64)
        open_rows = np.arange(len(state))
        while len(open_rows):
            at = ahead[open_rows]
            grown[open_rows] = at
            inside = at < shards
            shard[open_rows[inside]] = at[inside]
            # The generator's multiplier is a fixed value of the method.
            state[open_rows] = state[open_rows] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[open_rows] >> np.uint64(33)).astype(np.float64) + 1
            ahead[open_rows] = ((at + 1) * (float(1 << 31) / draw)).astype(np.int64)
            open_rows = open_rows[ahead[open_rows] <= shards]
        return pd.DataFrame({"shard": shard.astype(np.int32), "grown_shard": grown.astype(np.int32)})

    return jump(F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows to shards by their key: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``slot`` numbers the rows of a shard from 0 without gaps, ``size`` is the text's
    UTF-8 bytes plus 8. A null text counts as empty; rows with a null key share a
    shard; repeated rows get slots of their own; an empty table gives no rows;
    other columns of ``docs`` are not looked at. No text is shuffled.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        jump_shards(F.col(key), shards).alias("placed"),
    ).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "placed.*")
    return place_within(rows, ["shard"], ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
