import json
from datetime import datetime
from functools import partial
from pathlib import Path

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from newsloom.functions.embedder import HashedWords
from newsloom.operators import audits, ingest
from newsloom.plans.search import hybrid_search, lexical_topk, semantic_topk
from newsloom.plans.single import article_by_link_hash, make_hashed_link, search_by_tag_names
from newsloom.plans.upload import upload, upload_files
from newsloom.sources.store import Store, empty_store, open_store

from spark_plans import plan_of
from corpus import articles, category_rows, key, summary_rows

EMBEDDER = partial(HashedWords, 64)
NOW = datetime(2024, 5, 6, 7, 8, 9)


def send(spark, path, run, category, summaries):
    upload(path, run, category, summaries, ["line"], ["line"], NOW, EMBEDDER)
    return open_store(spark, path)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    return send(spark, path, 0, category_rows(spark), summary_rows(spark))


def counts(store):
    return {n: getattr(store, n).count() for n in Store.names()}


def test_two_articles_with_a_shared_tag(spark, tmp_path):
    rows = articles()[:2]
    rows[0]["tags"], rows[1]["tags"] = ["tag1", "tag2", "tag3"], ["tag1", "tag4", "tag5"]
    store = send(spark, str(tmp_path), 0, category_rows(spark, rows), summary_rows(spark, rows))
    assert counts(store) == {
        "articles": 2, "tags": 5, "article_tags": 6, "key_insights": 4, "embeddings": 2,
    }
    for row in rows:
        found = article_by_link_hash(store, row["link_hash"])
        assert found.headline == row["headline"] and str(found.published_date) == row["date"]
        assert found.summarization == row["summarization"] and found.link == row["link"]
        assert found.tag_names == sorted(row["tags"])
        assert found.key_insights == sorted(row["key_insights"])
    vectors = store.embeddings.collect()
    assert all(len(v.embedding) == 64 and abs(sum(x * x for x in v.embedding) - 1) < 1e-5 for v in vectors)
    assert {(v.created_at, v.updated_at) for v in vectors} == {(NOW, NOW)}
    assert audits.unique_audit(store).count() == 0 and audits.orphan_audit(store).count() == 0


def test_repeats_and_later_runs(spark, tmp_path):
    rows, path = articles(), str(tmp_path)
    again = [{**rows[1], "headline": "second listing"}, {**rows[0], "headline": "first relisted"}]
    early = rows[:3] + again
    summaries = summary_rows(spark, rows + [{**rows[2], "summarization": "late copy"}])
    first = send(spark, path, 0, category_rows(spark, early), summaries)
    assert counts(first)["articles"] == 3
    assert {r.headline for r in first.articles.collect()} == {r["headline"] for r in rows[:3]}
    assert "late copy" not in {r.summarization for r in first.embeddings.collect()}
    before = {r.link_hash: r.article_id for r in first.articles.collect()}
    repeated = send(spark, path, 0, category_rows(spark, early), summaries)
    assert {r.link_hash: r.article_id for r in repeated.articles.collect()} == before
    second = send(spark, path, 1, category_rows(spark, rows), summaries)
    after = {r.link_hash: r.article_id for r in second.articles.collect()}
    assert len(after) == 17 and before.items() <= after.items()
    assert sorted(after.values()) == list(range(1, 18))
    third = send(spark, path, 2, category_rows(spark, rows), summaries)
    assert counts(third) == counts(second)
    assert audits.unique_audit(third).count() == 0 and audits.orphan_audit(third).count() == 0


def broken_embedder():
    raise RuntimeError("no model")


def test_a_run_that_broke_off_is_passed_over(spark, tmp_path):
    rows, path = articles(), str(tmp_path)
    send(spark, path, 0, category_rows(spark, rows[:4]), summary_rows(spark))
    with pytest.raises(PythonException):
        upload(
            path, 1, category_rows(spark, rows[:9]), summary_rows(spark), ["line"], ["line"], NOW, broken_embedder
        )
    assert (tmp_path / "article_tags" / "run=1").exists()
    assert counts(open_store(spark, path))["article_tags"] == 9
    later = send(spark, path, 2, category_rows(spark, rows), summary_rows(spark))
    assert counts(later) == {
        "articles": 17, "tags": 20, "article_tags": 36, "key_insights": 34, "embeddings": 17,
    }
    assert audits.unique_audit(later).count() == 0 and audits.orphan_audit(later).count() == 0


def test_upload_of_files(spark, tmp_path):
    rows = articles()
    listed = rows + [{**rows[0], "headline": "listed again"}]
    for name, part in (("category", listed), ("summaries", rows[:9])):
        lines = [json.dumps(r) + "\n" for r in part]
        (tmp_path / f"{name}.jsonl").write_text("".join(lines))
    path, files = str(tmp_path / "store"), [str(tmp_path / f"{n}.jsonl") for n in ("category", "summaries")]
    upload_files(spark, path, 0, *files, NOW, EMBEDDER)
    stored = open_store(spark, path)
    assert counts(stored)["articles"] == 9
    assert article_by_link_hash(stored, rows[0]["link_hash"]).headline == rows[0]["headline"]
    left = list(Path(spark.conf.get("spark.checkpoint.dir")).glob("newsloom/checked-*"))
    assert left == []  # steps are deleted once the tables are written


def test_refused_articles_and_repeated_lists(spark, tmp_path):
    rows = articles()[:6]
    rows[0]["headline"] = None
    rows[1]["link"] = "https://example.com/" + "x" * 300
    rows[2]["key_insights"] = ["One.", "One.", "Two."]
    rows[3]["tags"] = ["a", "a", "b"]
    rows[4]["key_insights"] = ["y" * 1001]
    rows[5]["tags"] = ["ok", None]
    rows.append({**articles()[6], "date": "some day"})
    store = send(spark, str(tmp_path), 0, category_rows(spark, rows), summary_rows(spark, rows))
    assert counts(store)["articles"] == 2 and counts(store)["key_insights"] == 4
    assert {r.tag for r in store.tags.collect()} == {*rows[2]["tags"], "a", "b"}
    refused = {r.link_hash: r.reason for r in spark.read.parquet(f"{tmp_path}/refused").collect()}
    assert refused == {
        rows[0]["link_hash"]: "headline_missing",
        rows[1]["link_hash"]: "link_too_long",
        rows[4]["link_hash"]: "key_insight_too_long",
        rows[5]["link_hash"]: "tag_missing",
        rows[6]["link_hash"]: "date_missing",
    }


def test_join_multiplies_repeated_keys_and_first_rows_do_not(spark):
    rows = articles()[:1]
    category, summaries = category_rows(spark, rows * 3), summary_rows(spark, rows * 2)
    assert ingest.join_inputs(category, summaries).count() == 6
    nothing = empty_store(spark).articles
    fresh = ingest.new_articles(category, summaries, nothing, ["line"], ["line"])
    assert fresh.count() == 1
    assert "WindowGroupLimit" in plan_of(fresh)


def test_embedding_changes(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "article_id bigint, summarization string")
    incoming = spark.createDataFrame(
        [(1, "a"), (2, "B"), (3, None), (4, "d")], "article_id bigint, summarization string"
    )
    changes = ingest.embedding_changes(incoming, stored)
    assert {(r.article_id, r.change) for r in changes.collect()} == {(2, "changed"), (4, "new")}
    assert all(len(r.embedding) == 8 for r in ingest.embedded(changes, partial(HashedWords, 8)).collect())


def test_search_finds_the_animals(store):
    got = search_by_tag_names(store, "animal,zoo", make_embedder=EMBEDDER).orderBy("article_position_id").collect()
    animals = {r["link_hash"]: r for r in articles()[:12]}
    assert {r.link_hash for r in got} <= set(animals)
    assert [r.article_position_id for r in got] == list(range(1, len(got) + 1))
    assert set(got[0].asDict()) == {
        "article_position_id", "embedding_position_id", "summarization", "distance", "link",
        "link_hash", "headline", "published_date", "tag_names", "key_insights",
    }
    assert [r.tag_names for r in got[:2]] == [["zoo"], ["zoo"]]
    assert all(r.tag_names == [] for r in got[2:])
    assert all(r.key_insights == sorted(animals[r.link_hash]["key_insights"]) for r in got)
    assert [r.distance for r in got[2:]] == sorted(r.distance for r in got[2:])


def test_search_for_unknown_tags_still_answers(store):
    got = search_by_tag_names(store, "hector,achilles", 4, EMBEDDER).collect()
    assert len(got) == 4
    assert sorted(r.embedding_position_id for r in got) == [1, 2, 3, 4]


def test_tags_match_exactly(store):
    lists = [search_by_tag_names(store, t, 17, EMBEDDER).where("size(tag_names) > 0").count() for t in ("zoo", " zoo", "Zoo", "wildlife,zoo")]
    assert lists == [2, 0, 0, 12]


def test_requests_without_tags_or_key_are_refused(store):
    for missing in ("", None):
        with pytest.raises(ValueError):
            search_by_tag_names(store, missing, make_embedder=EMBEDDER)
        with pytest.raises(ValueError):
            article_by_link_hash(store, missing)
    assert article_by_link_hash(store, key("https://example.com/none")) is None


def test_link_keys(spark):
    for row in articles():
        assert make_hashed_link(spark, row["link"]) == row["link_hash"]
    assert make_hashed_link(spark, "HTTPS://EXAMPLE.com") == key("https://example.com/")
    with pytest.raises(ValueError):
        make_hashed_link(spark, "nowhere")


def tiny_store(spark):
    """Articles 1-5; 3 has no insight, 4 no embedding, 5 no tag."""
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    return Store(
        articles=frame(
            [(i, f"h{i}", f"l{i}", f"t{i}") for i in range(1, 6)],
            "article_id bigint, link_hash string, link string, headline string",
        ).withColumn("date", F.lit("2020-01-01").cast("date")),
        tags=frame([(1, "a"), (2, "b")], "tag_id bigint, tag string"),
        article_tags=frame(
            [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2)], "article_id bigint, tag_id bigint"
        ),
        key_insights=frame([(i, f"k{i}", i) for i in (1, 2, 4, 5)], "key_insight_id bigint, key_insight string, article_id bigint"),
        embeddings=frame(
            [(1, "s1", 1, [1.0, 0.0]), (2, "s2", 2, [0.0, 1.0]), (3, "s3", 3, [1.0, 0.1]), (5, "s5", 5, [0.0, 0.0])],
            "embedding_id bigint, summarization string, article_id bigint, embedding array<float>",
        ),
    )


def test_limits_come_before_the_joins(spark):
    store = tiny_store(spark)
    asked = spark.createDataFrame(
        [(7, ["b", "a"], [1.0, 0.0])], "query_id bigint, tags array<string>, query_vec array<double>"
    )
    # 3 and 4 carry most tags; 3 has no insight and 4 no embedding, nothing fills their place.
    assert lexical_topk(store, asked, 2).count() == 0
    assert [(r.article_id, r.tag_names) for r in lexical_topk(store, asked, 3).collect()] == [(1, ["a"])]
    near = semantic_topk(store, asked, 4).orderBy("embedding_position_id").collect()
    assert [(r.embedding_position_id, r.article_id, r.distance) for r in near] == [(1, 1, 0.0), (2, 2, 1.0), (3, 5, None)]
    assert [r.article_id for r in semantic_topk(store, asked, 2).collect()] == [1]
    fused = hybrid_search(store, asked, 4).orderBy("article_position_id").collect()
    assert [(r.link, r.embedding_position_id, r.distance, r.tag_names) for r in fused] == [
        ("l1", 1, 0.0, ["a"]), ("l2", 2, 1.0, ["a"]), ("l5", 3, None, []),
    ]
    assert hybrid_search(store, asked, 0).count() == 0


def test_batch_of_requests_equals_single_requests(store, spark):
    from newsloom.operators.search_requests import embed_searches, validate_searches

    names = ["animal,zoo", "technology,phone", "wildlife", "hector", "zoo,technology"]
    raw = spark.createDataFrame(list(enumerate(names)), "query_id bigint, tag_names string")
    batch = hybrid_search(store, embed_searches(validate_searches(raw), EMBEDDER), 3).collect()
    for number, name in enumerate(names):
        single = search_by_tag_names(store, name, 3, EMBEDDER).collect()
        rows = [r.asDict() for r in batch if r.query_id == number]
        for r in rows:
            del r["query_id"]
        order = lambda r: r["article_position_id"]
        assert sorted(rows, key=order) == sorted((r.asDict() for r in single), key=order)


def test_cascade_delete(store, spark):
    gone = store.articles.where("headline like '%lions'").select("article_id")
    left = audits.cascade_delete(store, gone, store.tags.where("tag = 'zoo'").select("tag_id"))
    assert counts(left) == {
        "articles": 16, "tags": 19, "article_tags": 32, "key_insights": 32, "embeddings": 16,
    }
    assert audits.orphan_audit(left).count() == 0
    broken = Store(**{**vars(store), "articles": left.articles})
    assert {(r.rule, r.n_rows) for r in audits.orphan_audit(broken).collect()} == {
        ("article_tags_article", 3), ("key_insights_article", 2), ("embeddings_article", 1),
    }
    doubled = Store(**{**vars(store), "tags": store.tags.union(store.tags.where("tag = 'zoo'"))})
    assert {(r.rule, r.n_rows) for r in audits.unique_audit(doubled).collect()} == {("tags_tag", 2), ("tags_id", 2)}


def test_same_results_without_broadcasts(store, spark, monkeypatch):
    """Beyond the broadcast limits the joins shuffle; answers must not change."""
    from newsloom.operators import tag_match
    from newsloom.plans import search

    key_rows = store.articles.select("link_hash")
    def answers():
        found = search_by_tag_names(store, "zoo,technology,wildlife", 5, EMBEDDER).collect()
        looked_up = search.lookup_articles(store, key_rows).collect()
        return sorted(map(str, found)), sorted(map(str, looked_up))

    expected = answers()
    for module in (search, tag_match):
        monkeypatch.setattr(module, "small", lambda df, *_: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert answers() == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_lookup_of_an_article_without_vector(store):
    """The summary comes from the embedding row: an article without one is found, summary null."""
    from newsloom.plans import search

    bare = store.articles.orderBy("article_id").first()
    cut = Store(**{**vars(store), "embeddings": store.embeddings.where(F.col("article_id") != bare.article_id)})
    row = search.lookup_articles(cut, store.articles.where(F.col("article_id") == bare.article_id).select("link_hash")).first()
    assert row.found and row.link == bare.link and row.summarization is None
