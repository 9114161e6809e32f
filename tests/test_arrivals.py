import json
from datetime import datetime
from functools import partial

import pytest

from newsloom.functions.embedder import HashedWords
from newsloom.sources.store import open_store
from newsloom.streaming.arrivals import ingest_arrivals

from corpus import articles, category_rows

EMBEDDER = partial(HashedWords, 16)


def answer(row):
    content = json.dumps({k: row[k] for k in ("summarization", "tags", "key_insights")})
    body = {"choices": [{"message": {"content": content}}]}
    return json.dumps({"custom_id": f"summary_for_{row['link_hash']}_0", "response": {"body": body}})


def test_files_are_ingested_once_as_they_arrive(spark, tmp_path):
    rows, folder = articles(), tmp_path / "answers"
    folder.mkdir()
    store, progress = str(tmp_path / "store"), str(tmp_path / "progress")

    def arrive(name, part, **options):
        (folder / name).write_text("".join(answer(r) + "\n" for r in part) + "{broken\n")
        ingest_arrivals(
            spark, str(folder), category_rows(spark), ["line"], store, progress, datetime(2024, 1, 1), EMBEDDER, **options
        )
        found = open_store(spark, store).articles.collect()
        assert len({r.link_hash for r in found}) == len(found)
        return found

    assert len(arrive("a.jsonl", rows[:5])) == 5
    first = arrive("b.jsonl", rows[3:9], files_per_batch=1)
    assert len(first) == 9
    assert len(arrive("c.jsonl", rows[:2])) == 9
    last = arrive("d.jsonl", rows)
    assert {r.link_hash for r in last} == {r["link_hash"] for r in rows}
    assert sorted(r.article_id for r in last) == list(range(1, 18))
    quarantine = spark.read.parquet(f"{store}/quarantine")
    assert [r.value for r in quarantine.collect()] == ["{broken"] * 4
    with pytest.raises(ValueError, match="new progress folder"):
        ingest_arrivals(
            spark, str(folder), category_rows(spark), ["line"], store, str(tmp_path / "other"), datetime(2024, 1, 1), EMBEDDER
        )
    assert open_store(spark, store).articles.count() == 17
