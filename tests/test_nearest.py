import numpy as np
import pytest

from newsloom.operators import cells, nearest as module
from newsloom.operators.nearest import nearest

from spark_plans import plan_of


def brute(ids, vectors, query, k):
    scored = []
    for i, v in zip(ids, vectors):
        d = None
        if v is not None and len(v) == len(query) and None not in v:
            v = np.array(v)
            length = np.sqrt((v * v).sum()) * np.sqrt((query * query).sum())
            if length > 0:
                d = 1.0 - (v * query).sum() / length
        scored.append((d is None, d or 0.0, i))
    return [(i, None if missing else d) for missing, d, i in sorted(scored)[:k]]


def frames(spark, ids, vectors, queries):
    data = [(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors)]
    corpus = spark.createDataFrame(data, "article_id bigint, embedding array<float>").repartition(5)
    asked = spark.createDataFrame(
        [(q, [float(x) for x in v]) for q, v in enumerate(queries)], "query_id bigint, query_vec array<double>"
    )
    return corpus, asked


def as_lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.distance is None, r.distance or 0.0, r.article_id))
    return {q: sorted(v) for q, v in out.items()}


def check(df, ids, vectors, queries, k):
    got = as_lists(df)
    for q, query in enumerate(queries):
        want = brute(ids, vectors, query, k)
        assert [i for _, _, i in got.get(q, [])] == [i for i, _ in want]
        for (missing, d, _), (_, wanted) in zip(got.get(q, []), want):
            assert missing == (wanted is None)
            assert missing or abs(d - wanted) < 1e-9


@pytest.mark.parametrize("k", [1, 7, 500])
def test_equals_brute_force_with_copies_and_bad_vectors(spark, k):
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, size=(240, 6)).astype(float)
    base[:80] = base[0]  # a third are copies of one vector
    vectors = [list(v) for v in base] + [[0.0] * 6, None, [1.0, 2.0], [1.0, None, 0, 0, 0, 0]]
    ids = rng.permutation(len(vectors))
    queries = np.vstack([base[0], rng.normal(size=(4, 6)), np.zeros(6)])
    corpus, asked = frames(spark, ids, vectors, queries)
    check(nearest(corpus, asked, k), ids, vectors, queries, k)


def test_many_requests_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_REQUESTS", 4)
    rng = np.random.default_rng(6)
    vectors, queries = rng.normal(size=(100, 4)).astype("float32"), rng.normal(size=(19, 4))
    corpus, asked = frames(spark, range(100), vectors, queries)
    found = nearest(corpus, asked, 3)
    assert "MapInArrow" not in plan_of(found)  # every pass was written
    check(found, range(100), [list(map(float, v)) for v in vectors], queries, 3)


def test_no_limit_no_rows(spark):
    corpus, asked = frames(spark, [1], [[1.0]], [np.array([1.0])])
    assert nearest(corpus, asked, 0).count() == 0
    assert nearest(corpus, asked.limit(0), 5).count() == 0


def test_request_vectors_of_different_width_are_refused(spark):
    corpus, _ = frames(spark, [1], [[1.0]], [np.array([1.0])])
    asked = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "query_id bigint, query_vec array<double>")
    with pytest.raises(ValueError):
        nearest(corpus, asked, 1)


def test_only_short_lists_are_shuffled(spark):
    corpus, asked = frames(spark, range(3), np.eye(3), np.eye(3))
    plan = plan_of(nearest(corpus, asked, 2))
    shuffle = plan.index("Exchange hashpartitioning(query_id")
    assert plan.index("WindowGroupLimit", shuffle) < plan.index("MapInArrow")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cell_search(spark):
    rng = np.random.default_rng(7)
    vectors = [list(map(float, v)) for v in rng.normal(size=(400, 8)).astype("float32")]
    vectors += [[0.0] * 8, None]
    ids = list(range(len(vectors)))
    queries = rng.normal(size=(6, 8))
    corpus, asked = frames(spark, ids, vectors, queries)
    index = cells.build_cells(corpus, 6, seed=2)
    assert index.vectors.count() == len(vectors)
    check(cells.nearest_in_cells(index, asked, 5, 6), ids, vectors, queries, 5)

    exact = nearest(corpus, asked, 5)
    found, shares = [], []
    for nprobe in (1, 3, 6):
        part = cells.nearest_in_cells(index, asked, 5, nprobe)
        found.append(sum(r.n_found for r in cells.recall(part, exact).collect()))
        shares.append(cells.scanned_share(index, asked, nprobe))
    assert found == sorted(found) and found[-1] == 30
    assert shares == sorted(shares) and shares[0] < 0.5 and abs(shares[-1] - 1) < 1e-12
    assert "PartitionFilters: [isnotnull(cell" in plan_of(cells.nearest_in_cells(index, asked, 5, 1)) or (
        "PartitionFilters: [cell" in plan_of(cells.nearest_in_cells(index, asked, 5, 1))
    )
