"""Geometry and covers: areas, orientation, holes, refusals, and cover size against true area."""

import math

import pytest
from pyspark.sql import functions as F

from plotgraph.functions import cells, geometry
from plotgraph.operators import cover, overlap

M = 1 / 111320


def square(lng, lat, metres, dx=0.0):
    s, o = metres * M, dx * M
    return f"POLYGON(({lng + o} {lat}, {lng + o + s} {lat}, {lng + o + s} {lat + s}, {lng + o} {lat + s}, {lng + o} {lat}))"


CASES = [
    ("sq", square(1, 1, 200)),
    ("cw", "POLYGON((0.5 0.5, 0.5 0.51, 0.51 0.51, 0.51 0.5, 0.5 0.5))"),
    ("hole", "POLYGON((20 10, 20.01 10, 20.01 10.01, 20 10.01, 20 10), (20.003 10.003, 20.007 10.003, 20.007 10.007, 20.003 10.007, 20.003 10.003))"),
    ("multi", "MULTIPOLYGON(((5 20, 5.002 20, 5.002 20.002, 5 20.002, 5 20)), ((5.01 20, 5.012 20, 5.012 20.002, 5.01 20.002, 5.01 20)))"),
    ("pin", "POLYGON((7.25 51.5, 7.25 51.5, 7.25 51.5, 7.25 51.5))"),
    ("point", "POINT(7.25 51.5)"),
    ("line", "LINESTRING (7 51, 7.5 51.5, 8 51)"),
    ("bad", "a field by the lake"),
    ("none", None),
    ("dup", "POLYGON((1 1, 1 1, 1.001 1, 1.001 1.001, 1.001 1.001, 1 1.001, 1 1))"),
    ("bow", "POLYGON((3 3, 3.002 3.002, 3.002 3, 3 3.002, 3 3))"),
    ("z", "POLYGON Z ((1 1 5, 1.001 1 5, 1.001 1.001 5, 1 1.001 5, 1 1 5))"),
]


@pytest.fixture(scope="module")
def shapes(spark):
    df = spark.createDataFrame(CASES, "owner string, wkt string")
    return df.withColumn("shape", geometry.from_wkt(F.col("wkt"))).cache()


def test_reading(shapes):
    got = {r["owner"]: r for r in shapes.select("*", geometry.usable(F.col("wkt"), F.col("shape")).alias("why"), geometry.is_closed_point(F.col("shape")).alias("pin"), geometry.canonical(F.col("shape")).alias("c"), geometry.content_hash(F.col("shape")).alias("h")).collect()}
    assert {k: r["why"] for k, r in got.items() if r["why"]} == {"pin": "zero_area", "point": "not_polygonal", "line": "not_polygonal", "bad": "unparseable", "none": "no_geometry"}
    assert got["pin"]["pin"] and got["point"]["pin"] and not got["sq"]["pin"]
    assert got["cw"]["c"][0][0][:2] == [[0.5, 0.5], [0.51, 0.5]] or got["cw"]["c"][0][0][0] == got["cw"]["c"][0][0][-1]
    assert got["dup"]["c"] == got["z"]["c"] and got["dup"]["h"] == got["z"]["h"] and len(got["dup"]["c"][0][0]) == 5
    assert len(got["multi"]["c"]) == 2 and len(got["hole"]["c"][0]) == 2


def test_areas_and_centroid(spark, shapes):
    got = {r["owner"]: r for r in shapes.filter("owner in ('sq','hole','multi','cw')").select("owner", geometry.sphere_hectares(F.col("shape")).alias("ha"), (geometry.equal_area_acres(F.col("shape")) * geometry.HECTARES_PER_ACRE).alias("ha2"), geometry.centroid(F.col("shape")).alias("c"), geometry.total_area(F.col("shape")).alias("deg")).collect()}
    assert abs(got["sq"]["ha"] - 4) < 0.05 and abs(got["hole"]["deg"] - 1e-4 * 0.84) < 1e-9
    for r in got.values():
        assert abs(r["ha2"] / r["ha"] - 1) < 0.01
    assert abs(got["hole"]["c"]["lng"] - 20.005) < 1e-7 and abs(got["hole"]["c"]["lat"] - 10.005) < 1e-7
    inside = shapes.filter("owner = 'hole'").select(geometry.contains(F.col("shape"), F.lit(20.001), F.lit(10.001)), geometry.contains(F.col("shape"), F.lit(20.005), F.lit(10.005))).first()
    assert tuple(inside) == (True, False)


def test_covers(spark, shapes):
    plots = shapes.filter("owner in ('sq','hole','multi')").select("owner", geometry.canonical(F.col("shape")).alias("shape"))
    shifted = spark.createDataFrame([("sq10", square(1, 1, 200, 10))], "owner string, wkt string").select("owner", geometry.canonical(geometry.from_wkt(F.col("wkt"))).alias("shape"))
    c = cover.polygon_cover(plots.unionByName(shifted)).cache()
    leaf_area = {r["owner"]: r["n"] for r in c.groupBy("owner").agg(F.sum(cells.leaf_count(F.col("cell"))).alias("n")).collect()}
    assert abs(leaf_area["multi"] / leaf_area["hole"] - (2 * 0.002**2 * math.cos(math.radians(20))) / (1e-4 * 0.84 * math.cos(math.radians(10)))) < 0.06
    o = overlap.cover_overlap(spark.createDataFrame([("sq", "sq10")], "a string, b string"), c).first()
    assert abs(o["iou"] - 0.9048) < 0.03 and o["containment"] > 0.94
    ids = {r["owner"]: r for r in cover.with_identity(plots).collect()}
    assert len({r["geo_id"] for r in ids.values()}) == 3 and all(len(r["geo_id"]) == 64 and r["geo_id"].startswith(r["geo_id_short"]) for r in ids.values())


def test_box_cover(spark):
    box = spark.createDataFrame([("b", 1.0, 1.0, 1.002, 1.002)], "owner string, west double, south double, east double, north double")
    got = cover.box_cover(box, 15).select(cells.level(F.col("cell")).alias("l"), "cell").collect()
    assert {r["l"] for r in got} == {15} and len({r["cell"] for r in got}) == len(got) >= 1


def test_a_polygon_over_three_faces(spark):
    """Around a corner of the cube, where three faces meet; the third holds no vertex.  Sampled points are inside if and only if the cover has their cell."""
    lat = math.degrees(math.atan(1 / math.sqrt(2)))
    ring = [(45 + dx, lat + dy) for dx, dy in ((-20, -12), (25, -10), (6, 1.5), (-8, 1.2), (-20, -12))]
    wide = [(x, y) for x, y in ((-10, 35), (30, 42), (100, 35), (45, 60), (-10, 35))]
    text = lambda r: "POLYGON((" + ", ".join(f"{x} {y}" for x, y in r) + "))"
    plots = spark.createDataFrame([("corner", text(ring)), ("wide", text(wide))], "owner string, wkt string").select("owner", geometry.canonical(geometry.from_wkt(F.col("wkt"))).alias("shape"))
    got = {}
    for r in cover.polygon_cover(plots, 8).collect():
        got.setdefault(r["owner"], set()).add(r["cell"])
    vec = lambda x, y: (math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y)))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))

    def inside(r, p):
        """Even-odd rule along the great circle to the far side, by plain vectors: the winding of the ring seen from p."""
        angle = 0.0
        for a, b in zip(r, r[1:]):
            u, v = cross(p, vec(*a)), cross(p, vec(*b))
            angle += math.atan2(dot(p, cross(u, v)), dot(u, v))
        return abs(angle) > math.pi

    points = [(x + 0.013, y + 0.017) for x in range(-30, 125, 5) for y in range(10, 70, 4)]
    df = spark.createDataFrame(points, "lng double, lat double")
    rows = df.select("lng", "lat", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda n: cells.parent(cells.from_lat_lng(F.col("lat"), F.col("lng")), n)).alias("up")).collect()
    for owner, r in (("corner", ring), ("wide", wide)):
        faces = {c >> 61 & 7 for c in got[owner]}
        assert len(faces) == 3, faces
        hit = {(x["lng"], x["lat"]) for x in rows if set(x["up"]) & got[owner]}
        sure = {(x, y) for x, y in points if inside(r, vec(x, y))}
        assert sure <= hit and len(hit - sure) <= 0.1 * len(sure) + 3


def test_one_tasks_polygons(spark):
    """Polygons of one task's input are dealt over tasks, and an owner of two rows has the cover of both."""
    from plotgraph.functions.lineage import spread

    n = 3 * cover.POLYGONS
    plots = spark.range(n, numPartitions=1).select(F.col("id").cast("string").alias("owner"), geometry.from_wkt(F.lit(square(1, 1, 200))).alias("shape"))
    assert spread(plots, cover.POLYGONS).rdd.getNumPartitions() == 3
    one, two = (geometry.from_wkt(F.lit(square(1, 1, 200, dx))) for dx in (0, 100))
    rows = spark.range(1).select(F.lit("one").alias("owner"), one.alias("shape")).unionByName(spark.range(1).select(F.lit("two").alias("owner"), two.alias("shape")))
    apart = cover.polygon_cover(rows, 18)
    both = cover.polygon_cover(rows.withColumn("owner", F.lit("both")), 18)
    want = {r["cell"] for r in cells.normalise(apart.withColumn("owner", F.lit("both"))).collect()}
    assert want == {r["cell"] for r in both.collect()} and want


def test_merging(spark):
    """Three levels of complete siblings become one cell; three siblings stay."""
    top = 1 << 60
    kids = lambda c: [c + k * ((c & -c) >> 2) for k in (-3, -1, 1, 3)]
    fine = [x for a in kids(top) for b in kids(a) for x in kids(b)]
    rows = [("a", c) for c in fine] + [("b", c) for c in kids(top)[:3]] + [("c", top)]
    got = {(r["owner"], r["cell"]) for r in cells.merge(spark.createDataFrame(rows, "owner string, cell long")).collect()}
    assert got == {("a", top), ("c", top)} | {("b", c) for c in kids(top)[:3]}
