import random

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import common
from newsloom.llm.common import components, place_within
from newsloom.runtime import HANDED_BYTES, prepare


@pytest.mark.parametrize("seed, nodes, links", [(1, 40, 30), (2, 200, 260), (3, 60, 50)])
def test_components(spark, seed, nodes, links):
    rng = random.Random(seed)
    names = rng.sample(range(-1000, 1000), nodes)
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(links)]
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in pairs if a != b for n in (a, b)}
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(rows) == len(want)
    assert {r.node: r.component for r in rows} == want


def test_long_path(spark):
    pairs = [(i, i + 1) for i in range(100)]
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.component for r in rows} == {0} and len(rows) == 101


def test_places_are_gapless(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 AS g")
    placed = place_within(rows, ["g"], ["id"], "place", rows_per_bucket=50).collect()
    for g in range(3):
        assert sorted(r.place for r in placed if r.g == g) == list(range(sum(r.g == g for r in placed)))


def test_slices_give_memory_back(monkeypatch):
    """Before a task begins and after it, whatever the worker did before."""
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(True))
    batches = iter([pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 10, ""]})])
    parts = common.slices(batches, "text", 10)
    assert next(parts).num_rows == 2 and len(done) == 1
    assert [p.num_rows for p in parts] == [2] and len(done) == 2


def test_freed_memory_goes_back_to_the_system():
    """Many small freed arrays below one that lives on."""
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    rows = [np.ones(2_000) for _ in range(10_000)]
    kept = [rows[k] for k in range(0, 10_000, 500)]
    before = resident()
    rows.clear()
    common.give_back()
    assert resident() < before - 100_000_000 and all(k[0] == 1 for k in kept)


def test_workers_get_bounded_batches(spark):
    """By bytes, not by rows alone: a batch of 10,000 long texts is held by Spark and by the worker."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64())})

    texts = spark.range(0, 6_000, 1, 1).selectExpr("repeat(cast(id % 10 AS string), 2000) AS text")
    found = [r.bytes for r in texts.mapInArrow(sizes, "bytes long").collect()]
    assert sum(found) >= 12_000_000 and max(found) <= HANDED_BYTES + 10_000


def test_a_bound_of_the_session_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1000000")
        assert prepare(spark).conf.get(name) == "1000000"
        spark.conf.unset(name)
        assert prepare(spark).conf.get(name) == str(HANDED_BYTES)
    finally:
        spark.conf.set(name, before)
