"""Nothing is lost unseen, and the store refuses what would break it."""

import json
from datetime import datetime
from functools import partial

import pytest

from newsloom.functions.embedder import HashedWords
from newsloom.operators.numbering import hash_bucket
from newsloom.operators.tag_match import requested_tags
from newsloom.plans.preparation import extract_category
from newsloom.plans.upload import upload, upload_files
from newsloom.runtime import scratch, settle, shared_folder
from newsloom.sources.jsonl import append_new
from newsloom.sources.store import open_store
from pyspark.sql import functions as F

from corpus import articles, category_rows, summary_rows

EMBEDDER = partial(HashedWords, 64)
NOW = datetime(2024, 5, 6)


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_dump_lines_that_cannot_be_read(spark, tmp_path):
    row = {"category": "SCIENCE", "link": "https://a.example/1", "headline": "h", "date": "2016-01-02"}
    good, late = json.dumps(row), json.dumps({**row, "link": "https://a.example/2", "date": "01/02/2016"})
    dump = write(tmp_path / "dump.json", [good, good[:40], late, "[]", json.dumps({**row, "date": None})])
    out = str(tmp_path / "science.jsonl")
    extract_category(spark, dump, out)
    assert spark.read.json(out).count() == 1
    rejected = spark.read.json(str(tmp_path / "science.rejected.jsonl")).collect()
    assert sorted((r.value, r.reason) for r in rejected) == sorted(
        [(good[:40], "undecodable"), (late, "date_unreadable"), ("[]", "undecodable")]
    )


def test_upload_lines_that_cannot_be_read(spark, tmp_path):
    rows = articles()[:3]
    listed = [json.dumps({k: r[k] for k in ("link", "link_hash", "headline", "date")}) for r in rows]
    told = [json.dumps({k: r[k] for k in ("link_hash", "summarization", "tags", "key_insights")}) for r in rows]
    files = write(tmp_path / "c.jsonl", listed), write(tmp_path / "s.jsonl", [*told[:2], told[2][:30]])
    store = str(tmp_path / "store")
    upload_files(spark, store, 0, *files, NOW, EMBEDDER)
    assert open_store(spark, store).articles.count() == 2
    unread = spark.read.parquet(f"{store}/unread").collect()
    assert [(r.file, r.value, r.reason) for r in unread] == [("summary", told[2][:30], "undecodable")]


def test_a_link_is_stored_once(spark, tmp_path):
    rows, path = articles()[:3], str(tmp_path)
    rows[1]["link"] = rows[0]["link"]
    send = lambda run, some: upload(path, run, category_rows(spark, some), summary_rows(spark, some), ["line"], ["line"], NOW, EMBEDDER)
    send(0, rows)
    first = min(rows[0]["link_hash"], rows[1]["link_hash"])
    stored = {r.link_hash for r in open_store(spark, path).articles.collect()}
    assert stored == {first, rows[2]["link_hash"]}
    later = [{**rows[2], "link_hash": "f" * 32}]
    send(1, later)
    assert open_store(spark, path).articles.count() == 2
    refused = spark.read.parquet(f"{path}/refused")
    assert {r.reason for r in refused.collect()} == {"link_taken"} and refused.count() == 2


def test_a_lower_run_is_refused(spark, tmp_path):
    rows, path = articles()[:2], str(tmp_path)
    send = lambda run: upload(path, run, category_rows(spark, rows), summary_rows(spark, rows), ["line"], ["line"], NOW, EMBEDDER)
    send(5)
    with pytest.raises(ValueError, match="below the newest"):
        send(3)
    send(5)
    assert open_store(spark, path).articles.count() == 2


def test_rows_without_a_key_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    rows = spark.createDataFrame([(None, "a"), ("k", "b")], "link_hash string, v string")
    for _ in range(3):
        append_new(rows, path)
    assert spark.read.json(path).count() == 2


def test_long_tags_match(spark):
    tag = "t" * 300
    asked = requested_tags(
        spark.createDataFrame([(1, [tag, tag])], "query_id long, tags array<string>"),
        spark.createDataFrame([(7, tag)], "tag_id long, tag string"),
    )
    assert [(r.query_id, r.tag_id) for r in asked.rows.collect()] == [(1, 7)]


def test_buckets_grow_with_the_rows(spark):
    keys = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("k"))
    widths = [hash_bucket(keys, F.col("k"), n).agg(F.max(F.length("bucket"))).first()[0] for n in (10, 10**9, 10**12)]
    assert widths == [3, 4, 6]


def test_scratch_deletes_what_was_settled(spark):
    with scratch(spark):
        rows = settle(spark.range(5), "probe")
        folder = rows.inputFiles()[0]
        assert shared_folder(spark) in folder
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(folder.rsplit("/", 1)[0]).count()
