from collections import Counter
from zlib import crc32

from newsloom.llm import shards


def test_slots_sizes_and_growth(spark, hard_docs, hard_rows):
    rows = shards.shard_documents(hard_docs, 24).collect()
    want = Counter((i, len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t in hard_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_one_more_shard_only_takes(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    now = {r.doc_id: r for r in shards.shard_documents(docs, 24).collect()}
    then = {r.doc_id: r.shard for r in shards.shard_documents(docs, 25).collect()}
    assert all(now[i].grown_shard == then[i] for i in now)
    moved = [i for i in now if now[i].shard != then[i]]
    assert all(then[i] == 24 for i in moved)
    assert 0.8 < len(moved) / (20_000 / 25) < 1.2
    assert max(Counter(r.shard for r in now.values()).values()) < 1.2 * 20_000 / 24


def test_no_rows(no_docs):
    assert shards.shard_documents(no_docs).count() == 0
