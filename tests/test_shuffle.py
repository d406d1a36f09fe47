"""The epoch order is a permutation for every size, seed and epoch."""

import pytest
from pyspark.sql import functions as F

from voxquarry.operators import shuffle as sh


def plain(i, n, seed, epoch):
    a, b = sh.sides(n)
    x = i
    while True:
        left, right = x % a, x // a
        for k, (f, g, h) in enumerate(sh.keys_of(seed, epoch)):
            u = ((right if k % 2 == 0 else left) % sh.PRIME * f + g) % sh.PRIME
            v = (u * u + h) % sh.PRIME
            if k % 2 == 0:
                left = (left + v) % a
            else:
                right = (right + v) % b
        x = right * a + left
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 1000, 4097])
def test_bijection(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "number")
    for seed, epoch in ((0, 0), (0, 1), (9, 0)):
        got = {r.number: r.place for r in sh.epoch_order(rows, n, seed, epoch).collect()}
        assert got == {i: plain(i, n, seed, epoch) for i in range(n)}
        assert sorted(got.values()) == list(range(n))


def test_orders_differ_and_mix(spark):
    rows = spark.range(5000).withColumnRenamed("id", "number")
    first, second = ([r.place for r in sh.epoch_order(rows, 5000, 1, e).orderBy("number").collect()] for e in (0, 1))
    assert sum(a == b for a, b in zip(first, second)) < 30
    assert 1200 < sum(abs(a - b) for a, b in zip(first, first[1:])) / 4999 < 2200  # a third of n for random neighbours
    counts = [0] * 10
    for p in first[:1000]:
        counts[p // 500] += 1
    assert min(counts) > 60


def test_large_numbers(spark):
    n = 10**17 + 12345
    some = [0, 1, n - 1, n // 2, 10**16]
    rows = spark.createDataFrame([(i,) for i in some], "number bigint")
    assert {r.number: r.place for r in sh.epoch_order(rows, n, 3, 4).collect()} == {i: plain(i, n, 3, 4) for i in some}


def test_projection_only(spark):
    plan = sh.epoch_order(spark.range(100).withColumnRenamed("id", "number"), 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_numbers_are_consecutive(spark):
    rows = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "key int").repartition(6)
    numbered = sh.numbered(rows, ["key"])
    assert numbered.where(F.col("number") != F.col("key")).isEmpty()
    with pytest.raises(ValueError):
        sh.permuted(F.lit(0), 0)
