import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.ingest import number_new
from newsloom.operators.numbering import number_rows, range_bucket

from spark_plans import plan_of


@pytest.mark.parametrize("spread", ["even", "crowded"])
def test_numbers_follow_the_order_over_many_buckets(spark, spread):
    rng = random.Random(3)
    if spread == "even":
        values = rng.sample(range(10**12), 3000)
    else:  # two thirds of the values in a narrow range, the rest far apart
        values = list(range(500, 2500)) + rng.sample(range(10**15, 10**16), 1000)
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(7)
    bucketed = range_bucket(df, "v", rows_per_bucket=100)
    sizes = [r["count"] for r in bucketed.groupBy("bucket").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400
    numbered = number_rows(bucketed, ["bucket"], ["v"])
    got = {r.v: r.row_index for r in numbered.collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_one_small_bucket(spark):
    df = spark.createDataFrame([(5,), (1,)], "v bigint")
    rows = number_rows(range_bucket(df, "v"), ["bucket"], ["v"]).collect()
    assert {(r.v, r.row_index) for r in rows} == {(1, 0), (5, 1)}


def test_new_numbers_are_gap_free_and_follow_the_used_ones(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    ids = sorted(r.n for r in number_new(df, "n", F.md5("k"), ["k"], 41).collect())
    assert ids == list(range(42, 5042))


def test_no_window_over_all_rows(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k"))
    numbered = number_new(df, "n", F.col("k"), ["k"], 0)
    plan = plan_of(numbered)
    # The single partition holds the bucket sizes, below an aggregate; rows meet a hash exchange.
    assert plan.count("Exchange SinglePartition") == 1
    below = plan[plan.index("Exchange SinglePartition") :]
    assert "HashAggregate(keys=[bucket" in below
