import math
import random

from pyspark.sql import functions as F

from plotgraph.functions import geometry
from plotgraph.operators import registry

COUNTRIES = f"position long, country string, shape {geometry.SHAPE}"


def star(x, y, r, n, seed):
    rng = random.Random(seed)
    ring = [[x + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]
    return [*ring, ring[0]]


def inside(shape, x, y):
    odd = False
    for r in [r for polygon in shape for r in polygon]:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def box(w, s, e, n):
    return [[w, s], [e, s], [e, n], [w, n], [w, s]]


def test_against_whole_shapes(spark):
    """Large and small stars with many edges, holes, several parts, and points on corners and sides."""
    rng = random.Random(3)
    shapes = [
        [[star(-40.0, 10.0, 25.0, 400, 1)]], [[star(60.0, -20.0, 40.0, 3000, 2), box(58.0, -22.0, 62.0, -18.0)]], [[star(100.0, 45.0, 0.4, 60, 3)]], [[box(-10.0, 40.0, 0.0, 50.0)], [box(0.0, 40.0, 10.0, 50.0)], [box(-180.0, -90.0, -179.0, -89.0)]],
        [[box(-45.0, 5.0, -35.0, 15.0)]], [],
    ]
    countries = [(i, f"K{i}", s) for i, s in enumerate(shapes)] + [(9, "none", None)]
    points = [(i, rng.uniform(-70, 110), rng.uniform(-60, 60)) for i in range(3000)] + [(3000 + i, rng.uniform(99.5, 100.5), rng.uniform(44.5, 45.5)) for i in range(500)]
    points += [(4000 + i, x, y) for i, (x, y) in enumerate([(-10.0, 40.0), (0.0, 40.0), (0.0, 45.0), (10.0, 45.0), (5.0, 50.0), (-10.0, 50.0), (-180.0, -90.0), (58.0, -20.0), (62.0, -18.0), (-40.0, 5.0), (180.0, 90.0)])]
    want = {i: next((c for _, c, s in countries if s and inside(s, x, y)), "") for i, x, y in points}
    df = spark.createDataFrame([*points, (9999, None, 1.0)], "geo_id long, lng double, lat double")
    table = spark.createDataFrame(countries, COUNTRIES)
    for few, finest in ((16, 12), (2, 7)):
        got = {r["geo_id"]: r["country"] for r in registry.country_of(df, table, few, finest).collect()}
        assert got.pop(9999) == "" and got == want
    index = registry.country_index(table)
    assert index.agg(F.max(F.size("edges"))).first()[0] < 120
    assert index.filter("size(edges) = 0 and not inside").isEmpty()
    assert {r["country"] for r in registry.country_of(df.limit(5), table.limit(0)).collect()} == {""}
