"""Access decisions, dry runs, and streams that are too large."""

import zlib

from pyspark.sql import functions as F

from plotgraph.operators import credentials, ingest
from plotgraph.sources import readers


def test_access_without_keys_and_flags(spark):
    rows = [(1, True, None, None, None), (2, None, "ok", None, None), (3, None, None, "ok", False), (4, None, "expired", "ok", False), (5, None, "expired", "ok", True), (6, None, "expired", "revoked", None), (7, None, None, None, False)]
    df = spark.createDataFrame(rows, "id int, internal boolean, authority string, grant string, conceal boolean")
    status = lambda **keys: [r["status"] for r in credentials.authorise(df, **keys).orderBy("id").collect()]
    assert status() == [200, 200, 200, 401, 200, 404, 403]
    assert status(issuer=False) == [200] + [401] * 6
    assert status(authority=False) == [200, 401, 200, 401, 401, 401, 403]
    assert credentials.authorise(df.limit(0)).count() == 0


def test_a_dry_run_writes_nothing(spark, tmp_path):
    fields = spark.createDataFrame([("a", 1, None, "h", "g1"), ("b", 2, None, "h", "g2"), ("c", 3, "no_geometry", None, None)], "v1_geo_id string, position long, error string, content_hash string, geo_id string")
    aliases = spark.createDataFrame([], "v1_geo_id string, geo_id string")
    links = spark.createDataFrame([], "a string, b string, relation string, score double")
    path = f"{tmp_path}/aliases"
    count = lambda df: {r["outcome"]: r["fields"] for r in df.collect()}
    assert count(ingest.run(fields, aliases, links, path, dry_run=True)) == {"new": 2, "quarantined:no_geometry": 1}
    assert not (tmp_path / "aliases").exists()
    assert count(ingest.run(fields, aliases, links, path)) == {"new": 1, "same_as": 1, "quarantined:no_geometry": 1}
    assert sorted(map(tuple, spark.read.parquet(path).select("v1_geo_id", "geo_id").collect())) == [("a", "g1"), ("b", "g1")]


def test_a_status_list_that_unpacks_too_large_is_refused(spark, monkeypatch):
    packed = [zlib.compress(b"x" * 100), zlib.compress(b"x" * (credentials.UNPACKED + 1)), b"no stream", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(packed)], "i int, p binary")
    got = [r[0] for r in df.orderBy("i").select(credentials.inflate(F.col("p"))).collect()]
    assert bytes(got[0]) == b"x" * 100 and got[1:] == [None, None, None]


def test_a_sample_keeps_whole_rows(spark):
    fields = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "v1_geo_id string, n int")
    profiles = spark.createDataFrame([("t1", "x"), ("t2", "y")], "source_key string, m string")
    some, few = readers.sampled(fields, profiles, spark.createDataFrame([("b",), ("b",)], "v1_geo_id string"), spark.createDataFrame([("t2",)], "source_key string"))
    assert sorted(map(tuple, some.collect())) == [("b", 2), ("b", 3)] and [tuple(r) for r in few.collect()] == [("t2", "y")]
