"""Top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotgraph.llm import knn


def brute(rows, k, step):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(1024 * x) for x in v]
            seen[i] = min(seen.get(i, q), q)
    out = []
    for i in seen:
        if i % step == 0:
            s = sorted((-sum(a * b for a, b in zip(seen[i], seen[j])), j) for j in seen if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block", [512, 4])
def test_top_k(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        v = rng.normal(size=16) * rng.choice([0.1, 1, 3]) + (5 if i % 3 == 0 else 0)
        rows.append((i, [float(x) for x in v]))
    rows += [(300 + i, [1.0] * 16) for i in range(40)] + [(400, None), (405, [float("nan")] * 16), (410, [None] * 16), (415, []), (None, [1.0] * 16), (420, [2.0, 3.0]), (425, [1e9] * 16), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(5)
    got = sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 5 == 0, k=7, pivots=12, query_block=block).collect())
    assert got == brute(rows, 7, 5)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert knn.top_k(spark.createDataFrame([], schema), F.col("vec_id") >= 0).count() == 0
    assert knn.top_k(spark.createDataFrame([(1, [1.0])], schema), F.col("vec_id") == 0).count() == 0
    got = knn.top_k(spark.createDataFrame([(1, [1.0]), (2, [0.5])], schema), F.col("vec_id") == 1).collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 1024 * 512)]


def test_cells_are_pruned():
    centres = np.array([[1000.0, 0], [-1000, 0], [0, 1000]])
    near = {j: [1.0] * 3 for j in range(3)}
    assert knn.needed_cells(centres, {0: 2.0}, {0: 5.0, 1: 5.0, 2: 5.0}, near, 2) == [(0, 0)]


@pytest.mark.parametrize("values", [[1e30, 1.0], [1e12, 1e12]])
def test_what_fits_no_long_is_an_error(spark, values):
    df = spark.createDataFrame([(1, values), (2, values)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        knn.top_k(df, F.col("vec_id") == 1).collect()
