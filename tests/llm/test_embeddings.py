import numpy as np
import pytest

from newsloom.llm import embeddings


def table(spark, vectors, extra=()):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int").repartition(3)


def expected(vectors, cosine=0.9):
    ids = [i for i, _ in vectors]
    unit = np.array([v / np.linalg.norm(v) for _, v in vectors])
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], 1 << 60).min(axis=1))
        if (new == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), label)}
        label = new


def clusters(seed, groups, size, width=32, noise=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return [(i, centres[i % groups] + noise * rng.normal(size=width)) for i in range(groups * size)]


def test_recall_and_no_false_link(spark):
    vectors = clusters(1, 150, 4)
    want = expected(vectors)
    got = {r.vec_id: r for r in embeddings.near_vectors(table(spark, vectors)).collect()}
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n for n, _ in want.values()) > 0
    assert all(got[i].component_id >= c for i, (_, c) in want.items())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_one_large_cluster_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    vectors = clusters(2, 1, 150, noise=0.02)
    got = embeddings.near_vectors(table(spark, vectors)).collect()
    assert {r.component_id for r in got} == {0}
    assert {r.n_links for r in got} == {149}


@pytest.mark.parametrize("bundle", [0.0, 1.5])
def test_pairs_at_the_limit_with_the_keys_of_ten_million_rows(spark, monkeypatch, bundle):
    rng = np.random.default_rng(3)
    pairs, width = 600, 64
    one = rng.normal(size=(pairs, width)) / width**0.5
    one[:, 0] += bundle
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    aside = rng.normal(size=one.shape)
    aside -= (aside * one).sum(axis=1, keepdims=True) * one
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.93, (pairs, 1)) + 1e-9
    other = cosine * one + np.sqrt(1 - cosine**2) * aside
    vectors = list(enumerate(np.concatenate([one, other])))
    monkeypatch.setattr(embeddings, "KEY_BITS", np.log2(len(vectors)) - np.log2(10_000_000) + 4)
    want = expected(vectors)
    got = {r.vec_id: r for r in embeddings.near_vectors(table(spark, vectors)).collect()}
    assert sum(n for n, _ in want.values()) >= 2 * pairs
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [1, 0, 0, 0]), (1, [2, 0, 0, 0]), (2, [1, 0, 0, 0]), (3, None), (4, []), (5, [0, 0, 0, 0]), (6, [nan, 1, 0, 0]),
        (7, [inf, 0, 0, 0]), (8, [1, None, 0, 0]), (9, [1e300, 0, 0, 0]), (10, [1e-300, 0, 0, 0]), (11, [1, 0, 0]),
        (12, [0, 1, 0, 0]), (12, [0, 1, 0, 0]), (None, [1, 0, 0, 0]), (13, [-1, 0, 0, 0]), (14, [0.0, -0.0, 0, 1]), (15, [0, 0, 0, 1]),
    ]
    rows = embeddings.near_vectors(table(spark, vectors)).collect()
    assert len(rows) == len(vectors)
    got = {r.vec_id: (r.n_links, r.component_id) for r in rows}
    assert [got[i] for i in (0, 1, 2, 9, 10)] == [(4, 0)] * 5
    assert [got[i] for i in (3, 4, 5, 6, 7, 8, 11, 13)] == [(0, i) for i in (3, 4, 5, 6, 7, 8, 11, 13)]
    assert got[12] == (1, 12)
    assert got[14] == got[15] == (1, 14)
    assert got[None] == (0, None)


def test_no_rows(spark):
    assert embeddings.near_vectors(table(spark, [])).count() == 0
