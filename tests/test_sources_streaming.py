"""Readers, sinks and the upload stream."""

import json

import pytest
from pyspark.sql import functions as F

from plotgraph.functions import geometry
from plotgraph.operators import cover, inventory, overlap, resolve
from plotgraph.sources import readers, sinks
from plotgraph.streaming import uploads


def feature(geometry_, **properties):
    return {"type": "Feature", "geometry": geometry_, "properties": properties}


def point(x, y):
    return {"type": "Point", "coordinates": [x, y]}


def test_geojson(spark, tmp_path):
    good = {"type": "FeatureCollection", "features": [feature(point(1, 2), area="3"), feature({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]})]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text('{"type": "Feature"}')
    rows = readers.geojson_files(spark, str(tmp_path)).withColumn("shape", geometry.from_geojson(F.col("geometry"))).orderBy("row").collect()
    assert [r["error"] for r in rows] == ["not_a_feature_collection", None, None]
    assert rows[1]["shape"] == [[[[1.0, 2.0]]]] and rows[1]["properties"] == {"area": "3"} and len(rows[2]["shape"][0][0]) == 4


def test_legacy(spark):
    import hashlib

    l13 = hashlib.sha256(b"abcd").hexdigest()
    data = json.dumps({"wkt": "POINT (1 1)", "area_ha": 2.5, "13": ["ab", "cd"]})
    rows = [(l13, data, "K", None), ("f" * 64, json.dumps(data), "K", None), ("1" * 8 + "-1111-1111-1111-" + "1" * 12, "{}", None, None), ("odd", None, None, None)]
    got = {r["v1_geo_id"]: r for r in readers.legacy_fields(spark.createDataFrame(rows, "geo_id string, geo_data string, country string, created_at timestamp")).collect()}
    assert [got[r[0]]["v1_kind"] for r in rows] == ["l13_hash", "l20_hash", "uuid", "unknown"]
    assert got["f" * 64]["wkt"] == "POINT (1 1)" and got["f" * 64]["v1_l13_geo_id"] == l13
    users = spark.createDataFrame([(1, "a", None, None, None), (2, "b", None, None, None)], "id int, email string, phone string, first_name string, last_name string")
    links = spark.createDataFrame([(1, 10), (1, 11)], "user_id int, field_id int")
    profiles = readers.legacy_profiles(users, links, spark.createDataFrame([(10, "g")], "field_id int, geo_id string"))
    assert {r["source_key"]: r["v1_geo_ids"] for r in profiles.collect()} == {1: ["g"], 2: []}


def test_fixture_pairs_merge_and_nest(spark):
    f = readers.wkt_table(readers.fixture_fields(spark, 4).withColumnRenamed("v1_geo_id", "geo_id"))
    refused = {r["geo_id"]: r["refused"] for r in f.filter("refused is not null").collect()}
    assert refused == {"blank": "no_geometry", "track": "not_polygonal", "note": "unparseable", "stake": "zero_area"}
    plots = f.filter("geo_id in ('drawn_1', 'drawn_2', 'twin_1', 'twin_2', 'estate', 'garden')").select(F.col("geo_id").alias("owner"), geometry.canonical(F.col("shape")).alias("shape"))
    c = cover.polygon_cover(plots, 18).cache()
    pairs = resolve.candidates(c, c).filter("b < a")
    scored = overlap.cover_overlap(pairs, c).cache()
    outcome = lambda t: {(r["a"], r["relation"]) for r in resolve.best(resolve.verdicts(scored, t)).collect()}
    assert outcome(90.0) == {("drawn_2", "same_as"), ("twin_2", "same_as"), ("garden", "child_of")}
    assert ("drawn_2", "same_as") not in outcome(99.9)


def test_audit_fails_closed(spark, tmp_path):
    df = spark.range(3)
    assert sinks.audited(df, {"event": "traceback", "who": "x"}, str(tmp_path / "audit")).count() == 3
    (tmp_path / "file").write_text("x")
    with pytest.raises(sinks.AuditUnavailable):
        sinks.audited(df, {"event": "traceback"}, str(tmp_path / "file" / "audit"))
    line = json.loads(sinks.progress(spark.createDataFrame([(0, "created")], "row long, outcome string"), 3).first()[0])
    assert line["percentage"] == 33.33 and line["outcome"] == "created"


def test_stream(spark, tmp_path):
    def upload(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"row": i, "geometry": json.dumps(g), "declared_area": a}) for i, g, a in rows))

    def run():
        uploads.register_stream(spark, str(tmp_path / "in"), str(tmp_path / "plots"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return {r["row"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    square = {"type": "Polygon", "coordinates": [[[1, 1], [1.001, 1], [1.001, 1.001], [1, 1.001], [1, 1]]]}
    turned = {"type": "Polygon", "coordinates": [[[1, 1], [1, 1.001], [1.001, 1.001], [1.001, 1], [1, 1]]]}
    upload("a.json", [(1, point(5, 5), 1.0), (2, point(5, 5), 1.0), (3, point(6, 6), 9.0), (4, square, None), (5, {"type": "Blob"}, None), (6, {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [2, 2], [0, 0]]]}, None)])
    assert run() == {1: "created", 2: "exists", 3: "skipped", 4: "created", 5: "skipped", 6: "skipped"}
    upload("b.json", [(7, point(5, 5), 2.0), (8, point(7, 7), 0.0), (9, square, None)])
    got = run()
    assert got[7] == "exists" and got[8] == "created" and got[9] == "exists"
    assert run() == got and spark.read.parquet(str(tmp_path / "plots")).count() == 3
    same = spark.createDataFrame([(1, json.dumps(square), None), (2, json.dumps(turned), None)], uploads.FEATURES)
    assert uploads.identified(same).select("content_hash").distinct().count() == 1


def test_stream_resolves_by_overlap_and_distance(spark, tmp_path):
    def square(west, south, side):
        e, n = west + side, south + side
        return {"type": "Polygon", "coordinates": [[[west, south], [e, south], [e, n], [west, n], [west, south]]]}

    def upload(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"row": i, "geometry": json.dumps(g), "declared_area": 1.0}) for i, g in rows))
        uploads.register_stream(spark, str(tmp_path / "in"), str(tmp_path / "plots"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return {r["row"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    metre = 1 / 111_195
    first = [(1, square(1, 1, 0.005)), (2, square(1.00001, 1, 0.005)), (3, square(2, 2, 0.005)), (4, point(5, 5)), (5, point(5, 5 + 3 * metre)), (6, point(5, 5 + 30 * metre))]
    assert upload("a.json", first) == {1: "created", 2: "exists", 3: "created", 4: "created", 5: "exists", 6: "created"}
    # Row 12 is near row 11 only, which is no plot; 14 is nested in a plot, 15 overlaps one by half.
    second = [(10, square(1, 1.00001, 0.005)), (11, point(5, 5 - 6 * metre)), (12, point(5, 5 - 12 * metre)), (13, point(5, 5 - 14 * metre)), (14, square(2.001, 2.001, 0.002)), (15, square(2.0025, 2, 0.005))]
    got = upload("b.json", second)
    assert [got[i] for i in range(10, 16)] == ["exists", "exists", "created", "exists", "created", "created"]
    assert spark.read.parquet(str(tmp_path / "plots")).count() == 7


def test_bands_and_sample(spark):
    bands = spark.createDataFrame([(None,), (0.0,), (0.5,), (1.0,), (5.0,), (50.0,), (500.0,)], "a double").select(inventory.area_band(F.col("a"))).collect()
    assert [b[0] for b in bands] == ["unknown", "zero", "<1", "1-5", "5-50", "50-500", ">500"]
    fields = spark.createDataFrame([(f"f{i}", i, "uuid" if i < 6 else "other", None, "POINT (1 1)", 2.0) for i in range(12)], "v1_geo_id string, position long, kind string, l13 string, wkt string, area double")
    claims = spark.createDataFrame([("t", 0, i, f"f{i}") for i in range(12)], "source_key string, position long, item long, v1_geo_id string")
    taken, figures = inventory.budgeted_sample(fields, claims, 4, 5)
    assert figures.first().asDict() == {"budget": 4, "chosen": 4, "filler": 0, "exhausted": True}
    assert {r[0] for r in taken.select("stratum").collect()} == {"uuid_fallback"}
    taken, figures = inventory.budgeted_sample(fields, claims, 11, 5)
    assert figures.first()["exhausted"] is False and figures.first()["chosen"] == 11 and taken.filter("stratum = 'filler'").count() == figures.first()["filler"] == 6
