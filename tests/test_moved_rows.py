"""What the store's readers shuffle: narrow rows, each once, and as many as the input has."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from newsloom.operators import audits, tag_match
from newsloom.plans import revisions, search
from newsloom.sources.store import Store, empty_store, open_store

from spark_plans import plan_of
from test_revisions import first_store


def test_matches_are_not_shuffled(spark):
    """Requests times articles come out of the last join: nothing is exchanged above it."""
    tags = spark.createDataFrame([(1, "sea"), (2, "zoo")], "tag_id long, tag string")
    bridge = spark.createDataFrame([(a, t) for a in range(40) for t in (1, 2) if a % t == 0], "article_id long, tag_id long")
    requests = spark.createDataFrame([(q, ["sea", "zoo", "none"] if q % 2 else ["zoo"]) for q in range(10)], "query_id long, tags array<string>")
    asked = tag_match.requested_tags(requests, tags)
    matches = tag_match.tag_matches(tag_match.tagged_rows(bridge, asked), asked)
    assert "Aggregate" not in plan_of(matches) and "hashpartitioning" not in plan_of(matches)
    rows = {(r.query_id, r.article_id): r.tag_names for r in matches.collect()}
    expected = {(q, a): [*(["sea"] if q % 2 else []), *(["zoo"] if a % 2 == 0 else [])] for q in range(10) for a in range(40)}
    assert rows == {k: v for k, v in expected.items() if v}


def test_a_deletion_writes_a_row_per_article(spark):
    path = first_store(spark)
    revisions.delete_articles(path, 1, spark.createDataFrame([(2,), (2,), (None,)], "article_id long"))
    assert not Path(path, "deleted").exists()
    assert [tuple(r) for r in spark.read.parquet(f"{path}/cascade/run=1").collect()] == [(2,)]
    assert sorted((r.article_id, r.tag_id) for r in open_store(spark, path).article_tags.collect()) == [(1, 10), (3, 11)]
    assert open_store(spark, path, before_run=1).article_tags.count() == 4


def test_pairs_are_audited_by_article(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (None, 10), (None, 10), (3, None), (3, None)], "article_id long, tag_id long")
    store = Store(**{**vars(empty_store(spark)), "article_tags": pairs})
    found = audits.unique_audit(store).where("rule = 'article_tags_pair'")
    assert re.search(r"hashpartitioning\(article_id#\d+L?, \d", plan_of(found)) and not re.search(r"hashpartitioning\(article_id#\d+L?, tag_id", plan_of(found))
    assert [tuple(r) for r in found.collect()] == [("article_tags_pair", "1|10", 2)]


def test_lookup_shuffles_texts_by_article_only(spark):
    """Found keys, repeated and unknown ones, without any broadcast: texts are not dealt by link."""
    store = open_store(spark, first_store(spark))
    keys = spark.createDataFrame([("h1",), ("h1",), ("h3",), ("none",), (None,)], "link_hash string")
    rows = search.lookup_articles(store, keys).select("link_hash", "found", "summarization", F.concat_ws("|", "tag_names").alias("tags"))
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(
        [("h1", True, "text 1", "zoo")] * 2 + [("h3", True, "text 3", "sea"), ("none", False, None, ""), (None, False, None, "")], key=repr
    )
    plan = search.lookup_articles(store, keys)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    by_link = [len(p) - len(p.lstrip(" :+-")) for p in plan if "Join" in p and "link_hash" in p]
    by_article = [len(p) - len(p.lstrip(" :+-")) for p in plan if "Join" in p and "article_id" in p]
    assert max(by_link) > max(by_article[:3])
