"""Joins that deal heavy keys over several tasks, against plain joins."""

import pytest
from pyspark.sql import functions as F

from plotgraph.llm.groups import heavy_keys, spread_join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, how):
    keys = [None if i % 3 == 0 else f"k{i % 40}" for i in range(600)]
    left = spark.createDataFrame([(k, i % 2, i) for i, k in enumerate(keys)], "k string, j int, i long").repartition(6)
    right = spark.createDataFrame([(k, j, f"{k}-{j}") for k in [None, *[f"k{n}" for n in range(0, 40, 2)]] for j in (0, 1)], "k string, j int, v string")
    counts = left.groupBy("k", "j").agg(F.count("*").alias("_n"))
    got = spread_join(left, right, ["k", "j"], counts, ["i"], how)
    assert got.columns == ["k", "j", "i", "v"]
    known = {(r["k"], r["j"]): r["v"] for r in right.collect()}
    want = [(k, i % 2, i, known.get((k, i % 2))) for i, k in enumerate(keys) if how == "left" or (k, i % 2) in known]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    without = spread_join(left, right, ["k", "j"], counts, ["i"], how, nulls=False).filter("k is null")
    assert without.count() == (200 if how == "left" else 0) and without.filter("v is not null").count() == 0


def test_heavy_keys_are_few_and_split(spark):
    counts = spark.createDataFrame([(i, 10_000 if i < 2 else 1) for i in range(500)], "k int, _n long")
    heavy = {r["k"]: r["_salts"] for r in heavy_keys(counts, ["k"]).collect()}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert set(heavy) == {0, 1} and all(tasks / 2 < s <= tasks + 1 for s in heavy.values())
    assert heavy_keys(counts.limit(0), ["k"]).count() == 0
