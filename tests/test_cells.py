"""Cell expressions against plain Python and known positions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plotgraph.functions import cells

ROWS = cells.QUADRANT_TO_POSITION


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def leaf(lat, lng):
    phi, lam = math.radians(lat), math.radians(lng)
    p = (math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi))
    axis = max(range(3), key=lambda k: (abs(p[k]), -k))
    face = axis + 3 * (p[axis] < 0)
    x, y, z = p
    u, v = [(y / x, z / x) if face == 0 else None, (-x / y, z / y) if face == 1 else None, (-x / z, -y / z) if face == 2 else None, (z / x, y / x) if face == 3 else None, (z / y, -x / y) if face == 4 else None, (-y / z, -x / z) if face == 5 else None][face]
    ij = []
    for w in (u, v):
        s = 0.5 * math.sqrt(1 + 3 * w) if w >= 0 else 1 - 0.5 * math.sqrt(1 - 3 * w)
        ij.append(max(0, min(2**30 - 1, math.floor(s * 2**30))))
    o, pos = face & 1, face
    for k in range(29, -1, -1):
        q = ROWS[o][(ij[0] >> k & 1) * 2 + (ij[1] >> k & 1)]
        o ^= cells.TURN[q]
        pos = pos * 4 + q
    return pos * 2 + 1


def up(i, level):
    b = 1 << 2 * (30 - level)
    return i & -b & (2**64 - 1) | b


def token(i):
    return f"{i:016x}".rstrip("0")


@pytest.fixture(scope="module")
def points():
    rng = random.Random(1)
    return [(0.0, 0.0), (40.7128, -74.006), (36.0, -121.0), (14.75, -88.25)] + [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(150)]


def test_positions_and_levels(spark, points):
    df = spark.createDataFrame(points, "lat double, lng double").withColumn("c", cells.from_lat_lng(F.col("lat"), F.col("lng")))
    df = df.withColumn("t", cells.id_to_token(F.col("c")))
    for n in (0, 10, 13, 20):
        df = df.withColumn(f"p{n}", cells.id_to_token(cells.parent(F.col("c"), n)))
    df = df.withColumn("back", cells.token_to_id(F.col("t"))).withColumn("l13", cells.token_level(F.col("p13"))).withColumn("size13", cells.leaf_count(cells.token_to_id(F.col("p13"))))
    got = df.collect()
    for r in got:
        want = leaf(r["lat"], r["lng"])
        assert r["c"] == signed(want) == r["back"] and r["t"] == token(want)
        for n in (0, 10, 13, 20):
            assert r[f"p{n}"] == token(up(want, n))
        assert r["l13"] == 13 and r["size13"] == 4**17
    assert [(r["t"], r["p10"], r["p13"], r["p20"]) for r in got[:4]] == [
        ("1000000000000001", "100001", "10000004", "10000000001"),
        ("89c25a220cf80969", "89c25b", "89c25a24", "89c25a220cf"),
        ("8092ddc33978a053", "8092dd", "8092ddc4", "8092ddc3397"),
        ("8f6431541494a657", "8f6431", "8f643154", "8f643154149"),
    ]


def test_centre_ring_neighbours(spark, points):
    df = spark.createDataFrame(points, "lat double, lng double").withColumn("c", cells.from_lat_lng(F.col("lat"), F.col("lng"))).withColumn("p", cells.parent(F.col("c"), 20))
    df = df.withColumn("mid", cells.centre(F.col("c"))).withColumn("ring", cells.ring(F.col("p"))).withColumn("near", cells.neighbours(F.col("p"))).withColumn("kids", cells.children(F.col("p")))
    for r in df.collect():
        assert abs(r["mid"]["lat"] - r["lat"]) < 1e-6 and min(abs(r["mid"]["lng"] - r["lng"]), 1) < 1e-5
        assert len(r["ring"]) == 5 and r["ring"][0] == r["ring"][4] and len(r["near"]) == 9 and r["p"] in r["near"]
        for d in (1e-5, -1e-5):  # about a metre away
            assert signed(up(leaf(r["lat"] + d, r["lng"]), 20)) in r["near"]
        assert all(signed(up(k % 2**64, 20)) == r["p"] for k in r["kids"]) and len(set(r["kids"])) == 4


def test_edge_of_a_face(spark):
    df = spark.createDataFrame([(0.0, 44.99999), (0.0, 45.00001), (44.9999, 10.0)], "lat double, lng double")
    near = df.select("lat", "lng", cells.point_blocking_cells(cells.from_lat_lng(F.col("lat"), F.col("lng"))).alias("n")).collect()
    for r in near:
        assert len(r["n"]) == 9
        for d in (1e-5, -1e-5):
            assert signed(up(leaf(r["lat"], r["lng"] + d), 20)) in r["n"]


def test_normalise(spark):
    base = up(leaf(10, 10), 12)
    kids = [base + k * (base & -base) // 4 for k in (-3, -1, 1, 3)]
    grand = [kids[0] + k * (kids[0] & -kids[0]) // 4 for k in (-3, -1, 1, 3)]
    rows = [("a", c) for c in grand + kids[1:]] + [("b", kids[0]), ("b", grand[1]), ("b", kids[0])] + [("c", grand[0]), ("c", kids[2])]
    df = spark.createDataFrame([(o, signed(c)) for o, c in rows], "owner string, cell long")
    got = sorted((r[0], r[1]) for r in cells.normalise(df).select("owner", "cell").collect())
    assert got == sorted([("a", signed(base)), ("b", signed(kids[0])), ("c", signed(grand[0])), ("c", signed(kids[2]))])


def test_shared_cells_are_what_two_covers_have_in_common(spark):
    from pyspark.sql import functions as F

    from plotgraph.operators import overlap

    base = spark.range(1).select(cells.parent(F.lit(2654435761 * 2 + 1).cast("long"), 12).alias("c")).first()["c"]
    kids = spark.range(1).select(cells.children(F.lit(base)).alias("k")).first()["k"]
    grand = spark.range(1).select(cells.children(F.lit(kids[0])).alias("k")).first()["k"]
    covers = spark.createDataFrame([("whole", base), *[("two", c) for c in kids[:2]], *[("fine", c) for c in (*grand[:3], kids[1])], ("last", kids[3]), *[("all", c) for c in kids]], "owner string, cell long")
    pairs = spark.createDataFrame([("whole", "two"), ("two", "fine"), ("two", "last"), ("whole", "all"), ("fine", "unknown")], "a string, b string")
    got = {}
    for r in overlap.shared_cells(pairs, covers).collect():
        got.setdefault((r["a"], r["b"]), set()).add(r["cell"])
    assert got == {("whole", "two"): set(kids[:2]), ("two", "fine"): {*grand[:3], kids[1]}, ("whole", "all"): {base}}


def test_tables_of_one_small_file_are_dealt(spark, tmp_path):
    """Points and covers of a file that is one task's input are made in several tasks."""
    from plotgraph.plans import lenses

    n = 2 * lenses.ROWS + 1
    key = spark.range(1, n + 1)
    key.selectExpr("id as c_custkey", "0L as c_nationkey", "0D as c_acctbal", "'x' as c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    key.selectExpr("id as p_partkey", "id % 4 as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for made in (lenses.points, lenses.covers):
        assert made(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_overlap_of_large_covers_is_not_sent_to_the_driver(spark):
    from plotgraph.operators import overlap

    top = 1 << 60
    low = top - 3 * (top >> 2)
    covers = spark.createDataFrame([("a", top), ("b", low), ("c", low), ("c", top + 3 * (top >> 2))], "owner string, cell long")
    found = overlap.cover_overlap(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("a", "none")], "a string, b string"), covers)
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    assert {(r["a"], r["b"]): (r["iou"], r["containment"]) for r in found.collect()} == {("a", "b"): (0.25, 1.0), ("b", "a"): (0.25, 1.0), ("c", "b"): (0.5, 1.0), ("a", "none"): (0.0, 0.0)}
