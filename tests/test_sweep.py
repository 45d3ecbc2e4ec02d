"""The interval join against brute force, and on one hot name."""

import random

import pytest
from pyspark.sql import functions as F

from patchweave.operators import sweep as S


@pytest.mark.parametrize("least", [3, 2_000])
def test_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(S, "LEAST_POINTS", least)
    monkeypatch.setattr(S, "RANGE_POINTS", 20 if least == 3 else 10**6)
    monkeypatch.setattr(S, "BATCH", 7)
    rng = random.Random(least)
    names = ["a", "a\0", "ab", "", "é", "z"]
    key = lambda: rng.choice([None, "", *"abcdefgh", "b\0", "\U0001f600", "é"])
    points = [(i, rng.choice([*names, None]), key()) for i in range(200)]
    intervals = [(i, rng.choice([*names, None]), key(), key(), rng.choice([True, False, None])) for i in range(100)]
    # In byte order, which is that of code points.
    inside = lambda k, lo, hi, c: (lo is None or k >= lo) and (hi is None or k < hi or (bool(c) and k == hi))
    want = sorted((p, i) for p, n, k in points for i, m, lo, hi, c in intervals if n is not None and n == m and k is not None and inside(k, lo, hi, c))
    got = S.interval_join(spark.createDataFrame(points, "p long, name string, key string"), spark.createDataFrame(intervals, "i long, name string, low string, high string, closed boolean"), "name")
    assert got.columns == ["p", "name", "key", "i"] and sorted((r.p, r.i) for r in got.collect()) == want and len(want) > 400
    assert S.interval_join(got.select("p", "name", "key").filter("false"), spark.createDataFrame(intervals, "i long, name string, low string, high string, closed boolean"), "name").count() == 0
    assert S.interval_join(spark.createDataFrame(points, "p long, name string, key string"), spark.createDataFrame([("a", "a", "b", True)], "name string, low string, high string, closed boolean"), "name").count() == sum(1 for _, n, k in points if n == "a" and k is not None and "a" <= k <= "b")


def test_one_name_with_very_many_versions_and_ranges(spark):
    """10^5 versions and 10^4 narrow ranges of one name: 10^9 pairs, of which the plan makes little more than the hits."""
    text = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    points = spark.range(100_000).select(F.lit("kernel").alias("name"), text("id").alias("key"), "id")
    intervals = spark.range(10_000).withColumn("x", F.col("id") * 10).withColumn("y", F.col("x") + 5).select(F.lit("kernel").alias("name"), F.col("id").alias("advisory"), text("x").alias("low"), text("y").alias("high"), F.lit(False).alias("closed"))
    got = S.interval_join(points, intervals, "name")
    assert got.count() == 50_000 and got.filter("id div 10 <> advisory").count() == 0
    cuts = S.borders(points, "name", "key")
    assert len(cuts) >= 3
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
