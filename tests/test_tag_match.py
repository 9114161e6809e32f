import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import tag_match

from spark_plans import plan_of


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 3), (3, 10), (4, 1000)])
def test_best_tagged_equals_brute_force(spark, seed, k):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(12)]
    carried = {}
    for article in rng.sample(range(10_000), 300):
        tags = {t for t in names if rng.random() < 0.15}
        if rng.random() < 0.4:
            tags.add("hot")
        carried[article] = tags
    requests = {q: rng.sample([*names, "hot", "absent"], rng.randint(1, 6)) for q in range(15)}
    requests[15] = ["absent"]
    requests[16] = ["hot", "hot"]

    tag_ids = {t: i for i, t in enumerate([*names, "hot"])}
    tags = spark.createDataFrame([(i, t) for t, i in tag_ids.items()], "tag_id bigint, tag string")
    pairs = [(a, tag_ids[t]) for a, ts in carried.items() for t in ts]
    bridge = spark.createDataFrame(pairs, "article_id bigint, tag_id bigint")
    asked = tag_match.requested_tags(
        spark.createDataFrame(list(requests.items()), "query_id bigint, tags array<string>"), tags
    )
    tagged = tag_match.tagged_rows(bridge, asked)
    carried_ids = tag_match.carried_tags(tagged)
    best = tag_match.best_tagged(carried_ids, asked, k)
    matches = tag_match.tag_matches(tagged, asked)
    every = spark.range(17).withColumnRenamed("id", "query_id").crossJoin(
        spark.createDataFrame([(a,) for a in carried], "article_id bigint")
    )
    own = tag_match.own_tags(carried_ids, every, asked)

    want_all, want_best = {}, {}
    for q, wanted in requests.items():
        hits = {a: sorted(ts & set(wanted)) for a, ts in carried.items() if ts & set(wanted)}
        want_all.update({(q, a): ts for a, ts in hits.items()})
        ranked = sorted(hits, key=lambda a: (-len(hits[a]), a))[:k]
        want_best.update({(q, a): hits[a] for a in ranked})
    assert {(r.query_id, r.article_id): r.tag_names for r in matches.collect()} == want_all
    assert {(r.query_id, r.article_id): r.own_tags for r in own.collect()} == want_all
    assert {(r.query_id, r.article_id): r.tag_names for r in best.collect()} == want_best


def test_frequent_tags_are_cut_before_the_shuffle(spark):
    carried = spark.createDataFrame([(1, [2])], "article_id bigint, carried array<bigint>")
    rows = spark.createDataFrame([(1, 2, "a")], "query_id bigint, tag_id bigint, tag string")
    plan = plan_of(tag_match.best_tagged(carried, tag_match.Asked(rows, 1), 5))
    shuffle = plan.index("Exchange hashpartitioning(carried")
    assert "WindowGroupLimit" in plan[shuffle:]


@pytest.mark.parametrize("requests", [10, 1_000])
def test_rows_before_the_last_ranking_are_bounded(spark, requests):
    """Many tag sets share one frequent tag: the last ranking sees at most k x requests x shares rows."""
    k = 3
    matched = spark.range(20_000).select(
        (F.col("id") % requests).alias("query_id"),
        F.array(F.lit(0), F.col("id")).alias("carried"),
        F.array(F.col("id")).alias("ids"),
        F.array(F.lit("frequent")).alias("tag_names"),
        F.lit(1).alias("n_tags"),
    )
    kept = tag_match.shortlist(matched, k)
    assert kept.count() <= k * requests * tag_match.SHORTLIST_SHARES
    best = kept.groupBy("query_id").agg(F.min(F.col("ids")[0]).alias("first")).collect()
    assert {r.query_id: r.first for r in best} == {q: q for q in range(requests)}
