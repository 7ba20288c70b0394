"""Joins with small tables on both sides of their bound, and recovery times across blocks, against plain Python."""

import random

import pytest

from tidelog.operators import checkers, small


def test_hint_only_below_the_bound(spark):
    table = spark.range(10).toDF("part")
    log = spark.range(100).selectExpr("id % 12 AS part")
    for most, hinted in ((10, True), (9, False)):
        met = log.join(small.small(table, most), "part")
        assert ("strategy=broadcast" in met._jdf.queryExecution().analyzed().toString()) == hinted
        assert met.count() == 84


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_recovery_over_blocks(spark, block):
    pick = random.Random(4)
    rows = [(pick.choice("ab"), pick.randrange(200), pick.random() < 0.1) for _ in range(120)] + [("c", 5, False), ("d", 3, False), ("d", 3, True)]
    want = []
    for node, t, ok in rows:
        later = [u for n, u, good in rows if good and n == node and u >= t]
        if not ok and later:
            want.append((node, min(later) - t))
    table = spark.createDataFrame(rows, "node string, op_time long, ok boolean")
    got = checkers.recovery_time(table.where("NOT ok"), table.where("ok"), block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_recovery_of_nothing(spark):
    table = spark.createDataFrame([], "node string, op_time long, ok boolean")
    assert checkers.recovery_time(table, table).count() == 0
