"""Reading plots and profiles from files and legacy tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import inventory

COLLECTION = "type string, features array<struct<type: string, geometry: string, properties: map<string,string>>>"


def geojson_text(df: DataFrame, text: str = "value") -> DataFrame:
    """``upload, row, geometry, properties, error`` of GeoJSON FeatureCollections, one text per row.

    A text that is no FeatureCollection gives one row with ``error``.  Geometry
    stays JSON text (see ``geometry.from_geojson``).
    """
    read = F.from_json(F.col(text), COLLECTION)
    rows = df.select(F.sha2(F.col(text), 256).alias("upload"), read.alias("c"))
    good = rows.filter("c.type = 'FeatureCollection' and c.features is not null")
    bad = rows.filter("not coalesce(c.type = 'FeatureCollection' and c.features is not null, false)")
    features = good.select("upload", F.posexplode("c.features").alias("row", "f")).select("upload", F.col("row").cast("long").alias("row"), "f.geometry", "f.properties", F.lit(None).cast("string").alias("error"))
    return features.unionByName(bad.select("upload", F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("geometry"), F.lit(None).cast("map<string,string>").alias("properties"), F.lit("not_a_feature_collection").alias("error")))


def geojson_files(spark: SparkSession, path: str) -> DataFrame:
    """``geojson_text`` of whole files; one upload is one file, so files bound the memory."""
    return geojson_text(spark.read.text(path, wholetext=True))


def wkt_table(df: DataFrame) -> DataFrame:
    """``df(geo_id, wkt)`` with ``shape`` and ``refused``, why it can't be used as a polygon."""
    rows = df.withColumn("shape", geometry.from_wkt(F.col("wkt")))
    return rows.withColumn("refused", geometry.usable(F.col("wkt"), F.col("shape")))


def decoded(column: str, schema: str) -> Column:
    """A JSON column parsed, whether it was encoded once or twice."""
    inner = F.from_json(F.concat(F.lit('{"s":'), F.col(column), F.lit("}")), "s string")["s"]
    return F.from_json(F.coalesce(F.when(F.col(column).startswith('"'), inner), F.col(column)), schema)


def legacy_fields(rows: DataFrame) -> DataFrame:
    """Legacy fields from ``rows(geo_id, geo_data, country, created_at)``.

    ``geo_data`` is JSON with ``wkt``, ``area_ha`` and level lists, encoded once
    or twice.  The level-13 hash is over the stored tokens in stored order; an
    id that is another hash is of the level-20 kind.
    """
    g = decoded("geo_data", "wkt string, area_ha double, field_name string, crop string, `13` array<string>")
    r = rows.withColumn("g", g)
    tokens = F.col("g.13")
    l13 = F.when(F.size(tokens) > 0, F.sha2(F.array_join(tokens, ""), 256))
    return r.select(F.col("geo_id").alias("v1_geo_id"), F.col("g.wkt").alias("wkt"), F.col("g.area_ha").alias("area_ha"), "country", F.col("g.field_name").alias("field_name"), F.col("g.crop").alias("crop"), "created_at", inventory.classify_id(F.col("geo_id"), l13).alias("v1_kind"), l13.alias("v1_l13_geo_id"))


def legacy_profiles(users: DataFrame, links: DataFrame, fields: DataFrame) -> DataFrame:
    """Profiles with the ids they claim: ``users(id, email, phone, first_name, last_name)``, ``links(user_id, field_id)``, ``fields(field_id, geo_id)``.

    Users without fields have an empty list; claims of missing fields have no id and are left out.
    """
    j = users.join(links, F.col("id") == F.col("user_id"), "left").join(fields, "field_id", "left")
    return j.groupBy("id", "email", "phone", "first_name", "last_name").agg(F.array_sort(F.collect_list("geo_id")).alias("v1_geo_ids")).withColumnRenamed("id", "source_key")


def sampled(fields: DataFrame, profiles: DataFrame, chosen: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The source restricted to chosen fields and profiles; inventories stay those of the whole source."""
    return fields.join(chosen.select("v1_geo_id").distinct(), "v1_geo_id", "left_semi"), profiles.join(keys.select("source_key").distinct(), "source_key", "left_semi")


def hexagon(lng: float, lat: float, radius: float) -> str:
    """WKT of a regular hexagon, ``radius`` in metres near the equator."""
    corners = [(lng + radius / 111_000 * math.cos(math.pi * k / 3), lat + radius / 111_000 * math.sin(math.pi * k / 3)) for k in range(7)]
    return "POLYGON ((" + ", ".join(f"{x:.7f} {y:.7f}" for x, y in corners) + "))"


def fixture_fields(spark: SparkSession, filler: int = 60) -> DataFrame:
    """Hexagonal fields with what an import has to cope with, and ``filler`` plain ones: ``v1_geo_id, wkt, owner``.

    A pair of twins, a pair drawn twice, a garden within an estate, four texts
    that give no polygon, and a field that nobody claims.
    """
    hazards = [
        ("twin_1", hexagon(-60, -3, 120), "coop-a"), ("twin_2", hexagon(-60, -3, 120), "coop-b"), ("drawn_1", hexagon(-61, -4, 1500), "coop-a"), ("drawn_2", hexagon(-61 + 30 / 111_000, -4, 1500), "coop-c"),
        ("estate", hexagon(-62, -5, 600), "coop-d"), ("garden", hexagon(-62, -5, 70), "coop-d"), ("blank", " ", "coop-e"), ("track", "LINESTRING (-60.5 -3.5, -60.4 -3.4, -60.3 -3.5)", "coop-e"),
        ("note", "twelve hectares by the river", "coop-e"), ("stake", "POLYGON ((-63.25 -6.5, -63.25 -6.5, -63.25 -6.5, -63.25 -6.5))", "coop-f"), ("nobodys", hexagon(-64, -7, 250), None),
    ]
    plain = [(f"plain-{k}", hexagon(-50 - 0.1 * k, 2, 30 * (k % 9 + 1)), f"coop-{'abcdefgh'[k % 8]}") for k in range(filler)]
    return spark.createDataFrame(hazards + plain, "v1_geo_id string, wkt string, owner string")
