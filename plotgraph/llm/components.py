"""Connected components of an edge list, without collecting anything to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, written
from .groups import spread_join


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the edges (a[i], b[i]): each node but the roots, with its root (the smallest node)."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a long, b long)``.

    Alternating large-star and small-star steps (each a grouped minimum and a
    join on the node) until the edge set stays the same; every round halves
    the paths, so the rounds grow with the logarithm of the longest path.
    Rounds are written to the shared folder; a node of many edges isn't one task's.  Self loops and repeated edges are harmless; nulls
    are dropped.  Returns ``node, component`` for nodes that have an edge to
    another node; no edges give no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, folder = written(e.filter("u > v").distinct(), "edges")
    state = None
    while True:
        new = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(new) == state or new["n"] == 0:
            break
        state = tuple(new)
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        # The centre of a large star is one key, so its edges are dealt over several tasks.
        large = spread_join(both, low.select("u", F.least("u", "m").alias("m")), ["u"], low, ["v"], nulls=False)
        large = cut(large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = spread_join(large, low.select("u", "m"), ["u"], low, ["v"], nulls=False)
        done = folder
        e, folder = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u > v").distinct(), "edges")
        remove(spark, done)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
