"""Queries over registrations: look-ups, disclosure and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, geometry
from ..operators import analytics, cover, registry, validity
from . import lenses
from .lenses import named, read, sql


def _plots(spark: SparkSession, d: str) -> DataFrame:
    """Parts as registered plots with full and short ids."""
    key = named("P", F.col("p_partkey"))
    full = F.sha2(key, 256)
    return read(spark, d, "part").select(full.alias("geo_id"), F.substring(full, 1, 16).alias("geo_id_short"), F.sha2(F.concat(F.lit("wkb-"), key), 256).alias("content_hash"), key.alias("key"), F.col("p_partkey").alias("k"))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """Full, short and old ids, content hashes, and ids that name nothing."""
    p, k = _plots(spark, d), F.col("k") % 5
    w = F.when(k == 0, F.col("geo_id")).when(k == 1, F.col("geo_id_short")).when(k == 2, F.concat(F.lit("old-"), "key")).when(k == 3, F.col("content_hash")).otherwise(F.concat(F.lit("none-"), "key"))
    return p.select(w.alias("wanted"))


def id_lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = _plots(spark, d)
    return registry.lookup(_wanted(spark, d), p, p.select(F.concat(F.lit("old-"), "key").alias("alias"), F.col("geo_id").alias("canonical")), p.select("content_hash", "geo_id"))


def id_translate(spark: SparkSession, d: str) -> DataFrame:
    return registry.translate(_wanted(spark, d), _plots(spark, d))


def _registrations(spark: SparkSession, d: str) -> DataFrame:
    """Events as registrations: when, by whom, where."""
    e = read(spark, d, "events")
    country = F.when(F.col("user_id") % 7 == 0, F.lit(None)).when(F.col("user_id") % 7 == 1, "").otherwise(F.concat(F.lit("C"), (F.col("user_id") % 9).cast("string")))
    return e.select(F.col("event_id").alias("geo_id"), F.col("ts").alias("created_at"), country.cast("string").alias("country"), "event_type", "value", "props", "user_id")


def count_total(spark: SparkSession, d: str) -> DataFrame:
    return analytics.count_total(_registrations(spark, d))


def count_by_country(spark: SparkSession, d: str) -> DataFrame:
    return analytics.count_by_country(_registrations(spark, d))


def count_by_month(spark: SparkSession, d: str) -> DataFrame:
    return analytics.count_by_month(_registrations(spark, d))


def _points(spark: SparkSession, d: str) -> DataFrame:
    p = lenses.points(spark, d)
    mask = F.when(F.col("k") % 3 == 0, "L0").when(F.col("k") % 3 == 1, "L1")
    return p.select("*", cells.from_lat_lng(F.col("lat"), F.col("lng")).alias("leaf"), F.lit("point").alias("kind"), F.col("declared_area").alias("area"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("country"), mask.alias("mask_level"), (F.col("k") % 4 == 0).alias("granted"))


def mask_l0(spark: SparkSession, d: str) -> DataFrame:
    seen = registry.masked(_points(spark, d))
    return seen.select("geo_id", "cell", F.size("outline").alias("corners"), "country", "kind", "area", "masking_level")


def wkt_gate(spark: SparkSession, d: str) -> DataFrame:
    return registry.disclosed(_points(spark, d)).select("geo_id", "tier", "wkt", "cell")


def centroid_gate(spark: SparkSession, d: str) -> DataFrame:
    """With a grant the true position; without, one that is the same for all plots of the coarse cell."""
    seen = registry.disclosed(_points(spark, d))
    coarse = seen.filter("tier = 'L0'").groupBy("cell").agg(F.count("*").alias("plots"), F.countDistinct(F.round("lat", 9), F.round("lng", 9)).alias("positions"))
    exact = seen.filter("tier = 'L1'").groupBy("cell").agg(F.count("*").alias("exact"))
    return coarse.join(exact, "cell", "full").select("cell", F.coalesce("plots", F.lit(0)).alias("plots"), F.coalesce("positions", F.lit(0)).alias("positions"), F.coalesce("exact", F.lit(0)).alias("exact"))


def published_area(spark: SparkSession, d: str) -> DataFrame:
    p = lenses.points(spark, d)
    kind = F.when(F.col("k") % 2 == 0, "point").otherwise("polygon")
    return p.select("geo_id", kind.alias("kind"), registry.published_area(kind, F.col("declared_area"), F.when(F.col("k") % 5 != 0, F.col("k") / 8.0)).alias("area"))


def geometry_kind(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    recorded = F.when(k % 4 == 0, "point").when(k % 4 == 1, "polygon").when(k % 4 == 2, "other")
    cover = F.when(k % 3 == 0, F.array(lenses.leaf(k))).when(k % 3 == 1, F.array(cells.parent(lenses.leaf(k), 20))).otherwise(F.array(lenses.leaf(k), lenses.leaf(k + 1)))
    return read(spark, d, "part").select(named("P", k).alias("geo_id"), registry.kind_of(recorded, cover).alias("kind"))


def level_projection(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    levels = F.create_map(*[x for n in (8, 13, 15, 18, 19, 20) for x in (F.lit(str(n)), cells.id_to_token(cells.parent(lenses.leaf(k), n)))], F.lit("30"), F.lit("leaf"), F.lit("wkt"), F.lit("POINT"), F.lit("regime"), F.lit("v2"))
    some, none = registry.project_levels(levels, [13, 20]), registry.project_levels(levels, [7])
    row = read(spark, d, "part").select(named("P", k).alias("geo_id"), some.alias("m"), none.alias("all"))
    return row.select("geo_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.col("m")["13"].alias("l13"), F.array_join(F.array_sort(F.map_keys("all")), ",").alias("all_keys"))


def cover_fallback(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    none, empty = F.lit(None).cast("array<string>"), F.array().cast("array<string>")
    v2 = F.when(k % 3 == 0, F.array(F.lit("v2"))).when(k % 3 == 1, empty).otherwise(none)
    at = F.when(k % 5 < 2, F.array(F.lit("level"))).otherwise(empty)
    s2 = F.when(k % 7 < 3, F.array(F.lit("s2"))).otherwise(none)
    return read(spark, d, "part").select(named("P", k).alias("geo_id"), F.array_join(registry.usable_cover(v2, at, s2), ",").alias("cover"))


def fields_for_point(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    probes = p.select(F.col("geo_id").alias("probe"), "lat", "lng")
    listed = p.select("geo_id", F.explode(F.array(*[cells.parent(F.col("leaf"), n) for n in (13, 20)])).alias("cell"))
    return registry.at_coordinate(probes, listed)


def _countries(spark: SparkSession) -> DataFrame:
    """25 boxes over the points' area, some overlapping, some gaps."""
    n = spark.range(25).select(F.col("id").alias("position"))
    west, south = F.lit(-89.0) + (F.col("position") % 5) * 0.4, F.lit(14.0) + F.floor(F.col("position") / 5) * 0.2
    east, north = west + 0.41, south + F.when(F.col("position") % 3 == 0, 0.1).otherwise(0.2)
    ring = F.array(*[F.array(x, y) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))])
    return n.select("position", F.concat(F.lit("K"), F.col("position").cast("string")).alias("country"), F.array(F.array(ring)).alias("shape"))


def country_join(spark: SparkSession, d: str) -> DataFrame:
    return registry.country_of(lenses.points(spark, d).select("geo_id", "lng", "lat"), _countries(spark))


def country_back_fill(spark: SparkSession, d: str) -> DataFrame:
    p = lenses.points(spark, d).withColumn("country", F.when(F.col("k") % 3 == 0, F.lit(None)).when(F.col("k") % 3 == 1, "").otherwise(F.concat(F.lit("C"), F.col("c_nationkey").cast("string"))).cast("string"))
    return registry.back_fill_country(p.select("geo_id", "country", "lng", "lat"), _countries(spark))


def regulatory_export(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    rows = p.select("geo_id", "kind", F.array(F.array(F.array(F.array(F.col("lng"), F.col("lat"))))).alias("shape"), "area", "country", "granted")
    e = registry.export_geojson(rows)
    return e.select("geo_id", "status", F.get_json_object("feature", "$.geometry.type").alias("geometry"), F.get_json_object("feature", "$.properties.Area").cast("double").alias("area"), F.get_json_object("feature", "$.properties.ProducerCountry").alias("country"))


def _squares(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as square polygons in WKT, every seventh broken, every fifth a pin."""
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    x, y, side = (F.pmod(k * 7919, F.lit(1000)) / 1000.0), (F.pmod(k * 104729, F.lit(1000)) / 1000.0), (1 + k % 9) / 1000.0
    number = lambda a: F.format_string("%.6f", a)
    corner = lambda a, b: F.concat_ws(" ", number(a), number(b))
    ring = F.concat_ws(", ", corner(x, y), corner(x + side, y), corner(x + side, y + side), corner(x, y + side), corner(x, y))
    wkt = F.when(k % 7 == 0, "NOT WKT").when(k % 5 == 0, F.concat(F.lit("POINT ("), corner(x, y), F.lit(")"))).otherwise(F.concat(F.lit("POLYGON (("), ring, F.lit("))")))
    return s.select(named("S", k).alias("geo_id"), wkt.alias("wkt"), side.alias("side"), k.alias("k"))


def geometry_parse(spark: SparkSession, d: str) -> DataFrame:
    s = _squares(spark, d).withColumn("shape", geometry.from_wkt(F.col("wkt")))
    return s.select("geo_id", geometry.wkt_kind(F.col("wkt")).alias("kind"), geometry.usable(F.col("wkt"), F.col("shape")).alias("refused"), F.round(geometry.total_area(F.col("shape")), 9).alias("square_degrees"))


def canonical_altered(spark: SparkSession, d: str) -> DataFrame:
    """Polygons shifted by a fraction of the sixth decimal are altered, the others aren't."""
    s = _squares(spark, d).withColumn("shape", geometry.from_wkt(F.col("wkt"))).filter(geometry.wkt_kind(F.col("wkt")) != "POINT")
    off = F.transform("shape", lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p, i: F.array(p[0] + F.when((F.col("k") % 3 == 0) & (i == 1), 0.0000004).otherwise(0.0), p[1]))))
    return s.select("geo_id", geometry.altered(off).alias("altered"))


def _crossed(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as shapes whose rings cross: bow ties, boxes that overlap, boxes side by side, boxes with a spike, and plain boxes."""
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    x, y, side = (F.pmod(k * 7919, F.lit(1000)) / 1000.0), (F.pmod(k * 104729, F.lit(1000)) / 1000.0), (1 + k % 9) * 2 / 1000.0
    at = lambda a, b: F.array(x + side * a, y + side * b)
    ring = lambda *points: F.array(*[at(a, b) for a, b in (*points, points[0])])
    box, one = lambda a, b: ring((a, b), (a + 1, b), (a + 1, b + 1), (a, b + 1)), lambda r: F.array(F.array(r))
    shape = (
        F.when(k % 5 == 0, one(ring((0, 0), (1, 1), (1, 0), (0, 1))))
        .when(k % 5 == 1, F.array(F.array(box(0, 0)), F.array(box(0.5, 0.5))))
        .when(k % 5 == 2, F.array(F.array(box(0, 0)), F.array(box(1, 0))))
        .when(k % 5 == 3, one(ring((0, 0), (1, 0), (1, 1), (1, 2), (1, 1), (0, 1))))
        .otherwise(one(box(0, 0)))
    )
    return s.select(named("S", k).alias("owner"), shape.alias("shape"))


def crossing_rings(spark: SparkSession, d: str) -> DataFrame:
    """Shapes made valid: whether they were repaired, their parts and area, and the content hash of bow ties."""
    valid = validity.make_valid(_crossed(spark, d))
    bow = F.expr("cast(substr(owner, 2) as long) % 5 = 0")
    return valid.select("owner", "repaired", F.size("shape").alias("parts"), F.round(geometry.total_area(F.col("shape")), 9).alias("square_degrees"), F.when(bow, geometry.content_hash(F.array_sort("shape"))).alias("content_hash"))


def polygon_covers(spark: SparkSession, d: str) -> DataFrame:
    """Covers of the squares by number of cells, leaves and first cell."""
    s = _squares(spark, d).withColumn("shape", geometry.from_wkt(F.col("wkt"))).filter(geometry.usable(F.col("wkt"), F.col("shape")).isNull())
    covers = cover.polygon_cover(s.select(F.col("geo_id").alias("owner"), geometry.canonical(F.col("shape")).alias("shape")))
    return covers.groupBy("owner").agg(F.count("*").alias("n_cells"), F.sum(cells.leaf_count(F.col("cell"))).alias("leaves"), F.min(cells.id_to_token(F.col("cell"))).alias("first_cell"))


def geometry_centroid(spark: SparkSession, d: str) -> DataFrame:
    s = _squares(spark, d).withColumn("shape", geometry.from_wkt(F.col("wkt"))).filter("shape is not null")
    c = geometry.centroid(F.col("shape"))
    return s.select("geo_id", F.round(c["lng"], 5).alias("lng"), F.round(c["lat"], 5).alias("lat"))


def area_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Hectares on the sphere, in whole hectares, and whether the equal-area projection agrees to one percent."""
    s = _squares(spark, d).withColumn("shape", geometry.from_wkt(F.col("wkt"))).filter(geometry.wkt_kind(F.col("wkt")) == "POLYGON")
    ha, acres = geometry.sphere_hectares(F.col("shape")), geometry.equal_area_acres(F.col("shape"))
    return s.select("geo_id", F.round(ha, 1).alias("hectares"), (F.abs(acres * geometry.HECTARES_PER_ACRE / ha - 1) < 0.01).alias("agree"), (acres > registry.ACRES_LIMIT).alias("too_large"))


def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """Features written as GeoJSON and read again."""
    p = lenses.points(spark, d)
    text = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")))
    shape = geometry.from_geojson(text)
    return p.select("geo_id", F.round(shape[0][0][0][0], 5).alias("lng"), F.round(shape[0][0][0][1], 5).alias("lat"), geometry.is_closed_point(shape).alias("pin"))


def bulk_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Lines as an upload: many repeat a part's geometry."""
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_quantity", "l_extendedprice", "l_tax")])
    row = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    digest = F.sha2(F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")), 256)
    rows = li.select(row.alias("row"), digest.alias("content_hash"), F.when(F.col("l_linenumber") % 2 == 0, "point").otherwise("polygon").alias("kind"), (F.col("l_quantity") / 8.0 - 0.5).alias("declared"), (F.col("l_extendedprice") / 50.0).alias("acres"), F.when(F.col("l_tax") > 0.065, "zero_area").alias("unusable"))
    known = rows.filter(F.substring("content_hash", 1, 1) == "a").select("content_hash")
    resolved = rows.filter("row % 9 = 0").select("row")
    return registry.registration_outcomes(rows, known, resolved)


QUERIES = {f.__name__: f for f in (
    id_lookup_fallback, id_translate, count_total, count_by_country, count_by_month, mask_l0, wkt_gate, centroid_gate, published_area, geometry_kind, level_projection,
    cover_fallback, fields_for_point, country_join, country_back_fill, regulatory_export, geometry_parse, canonical_altered, crossing_rings, polygon_covers, geometry_centroid, area_regimes, geojson_features, bulk_outcomes,
)}

_PLOTS = """keyed AS (SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS key, p_partkey AS k FROM part),
    plots AS (SELECT sha256(key) AS geo_id, substr(sha256(key), 1, 16) AS geo_id_short, sha256('wkb-' || key) AS content_hash, key, k FROM keyed),
    wanted AS (SELECT CASE k % 5 WHEN 0 THEN geo_id WHEN 1 THEN geo_id_short WHEN 2 THEN 'old-' || key WHEN 3 THEN content_hash ELSE 'none-' || key END AS wanted FROM plots)"""
_REGISTRATIONS = "r AS (SELECT event_id AS geo_id, ts AS created_at, CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'C' || (user_id % 9) END AS country FROM events)"
from .cell_queries import _CURVE  # noqa: E402

_COARSE = f"{_CURVE}, at10 AS (SELECT geo_id, max(token) FILTER (level = 10) AS cell FROM at_level GROUP BY geo_id)"
_SQUARES = """sq AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS geo_id, s_suppkey AS k, ((s_suppkey * 7919) % 1000) / 1000.0::DOUBLE AS x, ((s_suppkey * 104729) % 1000) / 1000.0::DOUBLE AS y, (1 + s_suppkey % 9) / 1000.0::DOUBLE AS side FROM supplier)"""
_COUNTRIES = """boxes AS (SELECT i AS position, 'K' || i AS country, -89.0::DOUBLE + (i % 5) * 0.4::DOUBLE AS west, 14.0::DOUBLE + (i // 5) * 0.2::DOUBLE AS south,
    -89.0::DOUBLE + (i % 5) * 0.4::DOUBLE + 0.41::DOUBLE AS east, 14.0::DOUBLE + (i // 5) * 0.2::DOUBLE + CASE WHEN i % 3 = 0 THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS north FROM (SELECT CAST(range AS BIGINT) AS i FROM range(25))),
    located AS (SELECT p.geo_id, coalesce(min_by(b.country, b.position), '') AS country FROM points p LEFT JOIN boxes b ON p.lng >= b.west AND p.lng < b.east AND p.lat >= b.south AND p.lat < b.north GROUP BY p.geo_id)"""

ORACLE_SQL = {
    "id_lookup_fallback": f"""WITH {_PLOTS}, found AS (
            SELECT wanted, geo_id, 'id' AS step, 0 AS rank FROM wanted JOIN plots ON wanted = geo_id OR wanted = geo_id_short
            UNION ALL SELECT wanted, geo_id, 'alias', 1 FROM wanted JOIN plots ON wanted = 'old-' || key UNION ALL SELECT wanted, geo_id, 'hash', 2 FROM wanted JOIN plots ON wanted = content_hash)
        SELECT w.wanted, min_by(geo_id, rank) AS geo_id, coalesce(min_by(step, rank), 'not_found') AS step FROM wanted w LEFT JOIN found USING (wanted) GROUP BY w.wanted""",
    "id_translate": f"WITH {_PLOTS} SELECT wanted, CASE WHEN wanted = geo_id THEN geo_id_short WHEN wanted = geo_id_short THEN geo_id END AS other FROM wanted LEFT JOIN plots ON wanted = geo_id OR wanted = geo_id_short",
    "count_total": "SELECT count(*) AS total FROM events",
    "count_by_country": f"WITH {_REGISTRATIONS}, g AS (SELECT country, count(*) AS plots FROM r GROUP BY country) SELECT CASE WHEN coalesce(country, '') = '' THEN 'Unknown' ELSE country END AS country, plots FROM g",
    "count_by_month": f"WITH {_REGISTRATIONS} SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS plots FROM r GROUP BY 1 ORDER BY 1",
    "mask_l0": sql("points", f"{_COARSE} SELECT geo_id, cell, 5 AS corners, 'C' || c_nationkey AS country, 'point' AS kind, round(declared_area, 1) AS area, CASE k % 3 WHEN 1 THEN 'L1' ELSE 'L0' END AS masking_level FROM points JOIN at10 USING (geo_id)"),
    "wkt_gate": sql("points", f"{_COARSE} SELECT geo_id, CASE WHEN k % 4 = 0 THEN 'L1' ELSE 'L0' END AS tier, CASE WHEN k % 4 = 0 THEN format('POINT ({{:.5f}} {{:.5f}})', lng, lat) END AS wkt, cell FROM points JOIN at10 USING (geo_id)"),
    "centroid_gate": sql("points", f"{_COARSE} SELECT cell, count(*) FILTER (k % 4 <> 0) AS plots, CAST(count(*) FILTER (k % 4 <> 0) > 0 AS BIGINT) AS positions, count(*) FILTER (k % 4 = 0) AS exact FROM points JOIN at10 USING (geo_id) GROUP BY cell"),
    "published_area": sql("points", "SELECT geo_id, CASE WHEN k % 2 = 0 THEN 'point' ELSE 'polygon' END AS kind, round(CASE WHEN k % 2 = 0 THEN coalesce(nullif(declared_area, 0), nullif(a, 0)) ELSE a END, 4) AS area FROM (SELECT *, CASE WHEN k % 5 <> 0 THEN k / 8.0::DOUBLE END AS a FROM points)"),
    "geometry_kind": "SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS geo_id, CASE WHEN p_partkey % 4 = 0 THEN 'point' WHEN p_partkey % 4 = 1 THEN 'polygon' WHEN p_partkey % 3 = 0 THEN 'point' ELSE 'polygon' END AS kind FROM part",
    "level_projection": "WITH l AS (SELECT p_partkey, p_partkey * 2654435761 * 2 + 1 AS leaf FROM part) SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS geo_id, '13,20,30,regime' AS keys, rtrim(lpad(format('{:x}', (leaf & -(1::BIGINT << 34)) | (1::BIGINT << 34)), 16, '0'), '0') AS l13, '13,15,18,19,20,30,8,regime' AS all_keys FROM l",
    "cover_fallback": "SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS geo_id, CASE WHEN p_partkey % 3 = 0 THEN 'v2' WHEN p_partkey % 5 < 2 THEN 'level' WHEN p_partkey % 7 < 3 THEN 's2' ELSE '' END AS cover FROM part",
    "fields_for_point": sql("points", f"{_CURVE}, at20 AS (SELECT geo_id, max(token) FILTER (level = 13) AS l13, max(token) FILTER (level = 20) AS l20 FROM at_level GROUP BY geo_id) SELECT a.geo_id AS probe, b.geo_id FROM at20 a JOIN at20 b ON a.l13 = b.l13 AND a.l20 = b.l20"),
    "country_join": sql("points", f"{_COUNTRIES} SELECT geo_id, country FROM located"),
    "country_back_fill": sql("points", f"{_COUNTRIES} SELECT p.geo_id, CASE WHEN k % 3 = 2 THEN 'C' || c_nationkey ELSE l.country END AS country FROM points p JOIN located l USING (geo_id)"),
    "regulatory_export": sql("points", "SELECT geo_id, CASE WHEN k % 4 <> 0 THEN 401 WHEN declared_area <= 0 OR declared_area > 4 THEN 422 ELSE 200 END AS status, CASE WHEN k % 4 = 0 AND declared_area > 0 AND declared_area <= 4 THEN 'Point' END AS geometry, CASE WHEN k % 4 = 0 AND declared_area > 0 AND declared_area <= 4 THEN round(declared_area, 4) END AS area, CASE WHEN k % 4 = 0 AND declared_area > 0 AND declared_area <= 4 THEN 'C' || c_nationkey END AS country FROM points"),
    "geometry_parse": f"WITH {_SQUARES} SELECT geo_id, CASE WHEN k % 7 = 0 THEN 'NOT' WHEN k % 5 = 0 THEN 'POINT' ELSE 'POLYGON' END AS kind, CASE WHEN k % 7 = 0 THEN 'unparseable' WHEN k % 5 = 0 THEN 'not_polygonal' END AS refused, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 0.0 ELSE round(side * side, 9) END AS square_degrees FROM sq",
    "canonical_altered": f"WITH {_SQUARES} SELECT geo_id, k % 7 = 0 OR k % 3 = 0 AS altered FROM sq WHERE k % 7 = 0 OR k % 5 <> 0",
    "crossing_rings": r"""WITH sq AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS owner, s_suppkey % 5 AS kind, ((s_suppkey * 7919) % 1000) * 1000 AS x, ((s_suppkey * 104729) % 1000) * 1000 AS y, (1 + s_suppkey % 9) * 2000 AS s FROM supplier),
            c AS (SELECT *, x / 1e6::DOUBLE AS x0, y / 1e6::DOUBLE AS y0, (x + s // 2) / 1e6::DOUBLE AS xm, (y + s // 2) / 1e6::DOUBLE AS ym, (x + s) / 1e6::DOUBLE AS x1, (y + s) / 1e6::DOUBLE AS y1, s / 1e6::DOUBLE AS side FROM sq)
        SELECT owner, kind <> 4 AS repaired, CAST(CASE WHEN kind IN (0, 1) THEN 2 ELSE 1 END AS INTEGER) AS parts, round(CASE kind WHEN 0 THEN side * side / 2 WHEN 1 THEN 1.5 * side * side WHEN 2 THEN 2 * side * side ELSE side * side END, 9) AS square_degrees,
            CASE WHEN kind = 0 THEN sha256(format('MULTIPOLYGON ((({:.6f} {:.6f}, {:.6f} {:.6f}, {:.6f} {:.6f}, {:.6f} {:.6f})), (({:.6f} {:.6f}, {:.6f} {:.6f}, {:.6f} {:.6f}, {:.6f} {:.6f})))', x0, y0, xm, ym, x0, y1, x0, y0, xm, ym, x1, y0, x1, y1, xm, ym)) END AS content_hash FROM c""",
    "geometry_centroid": f"WITH {_SQUARES} SELECT geo_id, round(CASE WHEN k % 5 = 0 THEN x ELSE round(x + side / 2, 7) END, 5) AS lng, round(CASE WHEN k % 5 = 0 THEN y ELSE round(y + side / 2, 7) END, 5) AS lat FROM sq WHERE k % 7 <> 0",
    "area_regimes": f"WITH {_SQUARES}, h AS (SELECT geo_id, 6371010.0 * 6371010.0 / 10000 * 2 * (atan(tan(radians(side) / 2) * (2 * tan(radians(y + side) / 2)) / (1 + pow(tan(radians(y + side) / 2), 2))) - atan(tan(radians(side) / 2) * (2 * tan(radians(y) / 2)) / (1 + pow(tan(radians(y) / 2), 2)))) AS ha FROM sq WHERE k % 7 <> 0 AND k % 5 <> 0) SELECT geo_id, round(ha, 1) AS hectares, true AS agree, ha / 0.404686 > 1000 AS too_large FROM h",
    "geojson_features": sql("points", "SELECT geo_id, round(lng, 5) AS lng, round(lat, 5) AS lat, true AS pin FROM points"),
    "bulk_outcomes": """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row, sha256(l_partkey || '-' || l_linenumber) AS content_hash, l_linenumber % 2 = 0 AS point, l_quantity / 8.0::DOUBLE - 0.5::DOUBLE AS declared, l_extendedprice / 50.0::DOUBLE AS acres, l_tax > 0.065::DOUBLE AS unusable FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice, min(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2))
        SELECT row, CASE WHEN content_hash LIKE 'a%' OR row_number() OVER (PARTITION BY content_hash ORDER BY row) > 1 THEN 'exists' WHEN (point AND (declared < 0 OR declared > 4)) OR unusable OR acres > 1000 THEN 'skipped' WHEN row % 9 = 0 THEN 'exists' ELSE 'created' END AS outcome FROM r""",
}
