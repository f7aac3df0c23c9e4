import random

import pytest
from pyspark.sql import functions as F

from plotgraph.functions import geometry
from plotgraph.operators import validity


def valid(spark, shapes):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], f"owner long, shape {geometry.SHAPE}")
    return {r["owner"]: r for r in validity.make_valid(rows).withColumn("area", geometry.total_area(F.col("shape"))).collect()}


def ring(*points):
    return [[float(x), float(y)] for x, y in (*points, points[0])]


BOX = ring((0, 0), (4, 0), (4, 4), (0, 4))


def test_known_shapes(spark):
    bow = [[ring((0, 0), (2, 2), (2, 0), (0, 2))]]
    star = [[ring((0, 3), (2, -3), (-3, 1), (3, 1), (-2, -3))]]
    twice = [[BOX], [ring((2, 2), (6, 2), (6, 6), (2, 6))]]
    side = [[BOX], [ring((4, 0), (8, 0), (8, 4), (4, 4))]]
    spike = [[ring((0, 0), (4, 0), (4, 4), (4, 8), (4, 4), (0, 4))]]
    holed = [[BOX, ring((1, 1), (1, 2), (2, 2), (2, 1))]]
    touching = [[BOX, ring((0, 0), (1, 2), (2, 1))]]
    poking = [[BOX, ring((3, 1), (6, 1), (6, 2), (3, 2))]]
    got = valid(spark, [bow, star, twice, side, spike, holed, touching, poking, [[BOX]], None, [], [[[[1.0, 2.0]]]], [[[[0.0, 0.0], [1.0, 1.0]]]]])
    assert (len(got[0]["shape"]), got[0]["area"], got[0]["repaired"]) == (2, 2.0, True)
    assert len(got[1]["shape"]) == 5 and got[1]["repaired"]
    assert (len(got[2]["shape"]), got[2]["area"]) == (2, 24.0)
    assert (len(got[3]["shape"]), got[3]["area"]) == (1, 32.0)
    assert (len(got[4]["shape"]), got[4]["area"]) == (1, 16.0)
    assert not got[5]["repaired"] and got[5]["area"] == 15.0
    assert got[6]["area"] == 16 - 1.5
    assert got[7]["area"] == 16 - 1 + 2
    for sound in (8, 9, 10, 11, 12):
        assert not got[sound]["repaired"], sound


def inside(shape, x, y):
    odd = False
    for polygon in shape:
        for r in polygon:
            for (ax, ay), (bx, by) in zip(r, r[1:]):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    odd = not odd
    return odd


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_rings_keep_their_points(spark, seed):
    """Points are inside before if they are inside after, and no two edges of a result cross."""
    rng = random.Random(seed)
    shapes = [[[ring(*[(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(rng.randint(4, 14))])] for _ in range(rng.randint(1, 2))] for _ in range(30)]
    got = valid(spark, shapes)
    wrong = total = 0
    for i, shape in enumerate(shapes):
        for _ in range(200):
            x, y = rng.uniform(0, 1), rng.uniform(0, 1)
            wrong += inside(shape, x, y) != inside(got[i]["shape"], x, y)
            total += 1
        plain = sum(abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:]))) / 2 * (1 if k == 0 else -1) for polygon in got[i]["shape"] for k, r in enumerate(polygon))
        assert abs(plain - got[i]["area"]) < 1e-9
    assert wrong <= total // 2000
    again = valid(spark, [got[i]["shape"] for i in range(len(shapes))])
    assert sum(abs(again[i]["area"] - got[i]["area"]) for i in range(len(shapes))) < 1e-4
