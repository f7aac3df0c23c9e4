"""Queries over cells, covers, overlap and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import overlap, resolve
from . import lenses
from .lenses import named, read, sql

def _token() -> Column:
    return cells.id_to_token(F.col("cell"))


def cell_levels(spark: SparkSession, d: str) -> DataFrame:
    c = lenses.covers(spark, d).select("owner", _token().alias("token"))
    return c.select("owner", "token", cells.token_level(F.col("token")).alias("level"), cells.leaf_count(cells.token_to_id(F.col("token"))).alias("leaves"))


def cell_ancestors(spark: SparkSession, d: str) -> DataFrame:
    c = lenses.covers(spark, d).distinct()
    up = c.select("owner", "cell", F.explode(cells.ancestors(F.col("cell"))).alias("up"))
    return up.select("owner", _token().alias("token"), cells.id_to_token(F.col("up")).alias("ancestor"), cells.level(F.col("up")).alias("level"))


def cell_children(spark: SparkSession, d: str) -> DataFrame:
    kids = lenses.region_cells(spark, d).select("region_id", F.explode(cells.children(F.col("cell"))).alias("cell"))
    return kids.select("region_id", _token().alias("token"), cells.level(F.col("cell")).alias("level"))


def cover_leaf_area(spark: SparkSession, d: str) -> DataFrame:
    return lenses.covers(spark, d).groupBy("owner").agg(F.sum(cells.leaf_count(F.col("cell"))).alias("leaves"), F.count("*").alias("n_cells"))


def blocking_keys(spark: SparkSession, d: str) -> DataFrame:
    plots = lenses.covers(spark, d).groupBy("owner").agg(F.collect_set("cell").alias("c"))
    return plots.select("owner", F.explode(cells.blocking_cells(F.col("c"))).alias("cell")).select("owner", _token().alias("key"))


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    return lenses.points(spark, d).withColumn("leaf", cells.from_lat_lng(F.col("lat"), F.col("lng")))


def point_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of point plots; compared down to level 20, where engines' sines agree."""
    at = lambda n: cells.id_to_token(cells.parent(F.col("leaf"), n))
    return _leaves(spark, d).select("geo_id", *[at(n).alias(f"l{n}") for n in (8, 10, 13, 20)])


def point_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """How many level-20 cells each point looks into, and whether its own is among them."""
    near = _leaves(spark, d).select("geo_id", cells.point_blocking_cells(F.col("leaf")).alias("near"), cells.parent(F.col("leaf"), 20).alias("own"))
    return near.select("geo_id", F.size("near").alias("n_cells"), F.array_contains("near", F.col("own")).alias("own_inside"))


def points_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """Part leaves in the regions' cells."""
    points = read(spark, d, "part").select(named("P", F.col("p_partkey")).alias("geo_id"), lenses.leaf(F.col("p_partkey")).alias("leaf"))
    return resolve.points_in_covers(points, lenses.region_cells(spark, d).withColumnRenamed("region_id", "owner"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    c = lenses.covers(spark, d)
    pairs = resolve.candidates(c, c).filter("b < a")
    # Blocking cells are shared by many places; only those of one place can overlap.
    return overlap.cover_overlap(pairs, c)


def blocking_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = lenses.covers(spark, d)
    return resolve.candidates(c, c).groupBy("a").agg(F.count("*").alias("candidates"), F.min("b").alias("first"))


def cover_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("iou > 0").select("a", "b", "shared", "leaves_a", "leaves_b", "iou")


def cover_containment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("containment >= 0.95").select("a", "b", "containment")


def token_overlap_pct(spark: SparkSession, d: str) -> DataFrame:
    tokens = lenses.covers(spark, d).groupBy("owner").agg(F.collect_list(_token()).alias("tokens"))
    pairs = read(spark, d, "part").select(named("P", F.col("p_partkey")).alias("a"), named("P", F.col("p_partkey") - F.col("p_partkey") % 5).alias("b"))
    return overlap.token_overlap_percent(pairs, tokens)


def overlap_two_plots(spark: SparkSession, d: str) -> DataFrame:
    """Every plot and the one with the next number; the last one's is unknown."""
    pairs = read(spark, d, "part").select(named("P", F.col("p_partkey")).alias("a"), named("P", F.col("p_partkey") + 1).alias("b"))
    return overlap.cover_overlap(pairs, lenses.covers(spark, d)).select("a", "b", "iou", "containment")


def cover_intersections(spark: SparkSession, d: str) -> DataFrame:
    """Of every two plots that share some area: the cells they share, with their leaves."""
    c = lenses.covers(spark, d)
    shared = overlap.shared_cells(resolve.candidates(c, c).filter("b < a"), c)
    return shared.groupBy("a", "b").agg(F.count("*").alias("n_cells"), F.sum(cells.leaf_count(F.col("cell"))).alias("leaves"), F.min(_token()).alias("first_cell"))


def resolve_best(spark: SparkSession, d: str) -> DataFrame:
    """Importer's choice for every plot among all earlier ones."""
    return resolve.best(resolve.verdicts(_scored(spark, d)))


def resolve_earliest(spark: SparkSession, d: str) -> DataFrame:
    """Live registration's choice: the earliest; later keys were registered earlier here."""
    created = read(spark, d, "part").select(named("P", F.col("p_partkey")).alias("b"), (-F.col("p_partkey")).alias("created_at"))
    return resolve.earliest(resolve.verdicts(_scored(spark, d)), created).select("a", "b", "relation", "score")


def resolve_batch(spark: SparkSession, d: str) -> DataFrame:
    """All plots registered in the order of their keys."""
    plots = read(spark, d, "part").select(named("P", F.col("p_partkey")).alias("id"), F.col("p_partkey").alias("at"))
    return resolve.resolve_batch(plots, resolve.verdicts(_scored(spark, d)))


def point_distance_join(spark: SparkSession, d: str) -> DataFrame:
    """Every point moved by about two metres finds its own registration."""
    p = lenses.points(spark, d)
    probes = p.select("geo_id", (F.col("lat") + 0.00002).alias("lat"), "lng")
    return resolve.near_points(probes, p).select("a", "b", F.round("metres", 3).alias("metres"))


QUERIES = {f.__name__: f for f in (
    cell_levels, cell_ancestors, cell_children, cover_leaf_area, blocking_keys, point_cells, point_neighbours, points_in_regions, blocking_candidates, cover_iou_pairs,
    cover_containment_pairs, token_overlap_pct, overlap_two_plots, cover_intersections, resolve_best, resolve_earliest, resolve_batch, point_distance_join,
)}

_HEX = "rtrim(lpad(format('{{:x}}', {}), 16, '0'), '0')"
_TOKEN = _HEX.format("cell")
_KEY = "(CASE WHEN (cell & -cell) < (1::BIGINT << 34) THEN (cell & -(1::BIGINT << 34)) | (1::BIGINT << 34) ELSE cell END)"
_COVERS = "places covers"
_LEVEL = "CAST(30 - bit_count((cell & -cell) - 1) // 2 AS INTEGER)"
_SCORED = f"""keys AS (SELECT DISTINCT owner, {_KEY} AS key FROM covers),
    pairs AS (SELECT DISTINCT x.owner AS a, y.owner AS b FROM keys x JOIN keys y ON x.key = y.key AND y.owner < x.owner),
    size AS (SELECT owner, CAST(sum(cell & -cell) AS BIGINT) AS leaves FROM covers GROUP BY owner),
    hits AS (SELECT x.owner AS a, c.owner AS b, x.cell FROM ancestors x JOIN covers c ON c.cell = x.up
        UNION ALL SELECT c.owner, x.owner, x.cell FROM ancestors x JOIN covers c ON c.cell = x.up AND x.up <> x.cell),
    both_hits AS (SELECT a, b, CAST(sum(cell & -cell) AS BIGINT) AS shared FROM hits GROUP BY a, b),
    scored AS (SELECT p.a, p.b, coalesce(h.shared, 0) AS shared, x.leaves AS leaves_a, y.leaves AS leaves_b,
        coalesce(h.shared, 0)::DOUBLE / (x.leaves + y.leaves - coalesce(h.shared, 0))::DOUBLE AS iou, coalesce(h.shared, 0)::DOUBLE / least(x.leaves, y.leaves)::DOUBLE AS containment
        FROM pairs p LEFT JOIN both_hits h USING (a, b) JOIN size x ON x.owner = p.a JOIN size y ON y.owner = p.b),
    passed AS (SELECT a, b, CASE WHEN iou * 100 >= 95 THEN 'same_as' ELSE 'child_of' END AS relation, CASE WHEN iou * 100 >= 95 THEN iou ELSE containment END AS score FROM scored WHERE iou * 100 >= 95 OR containment * 100 >= 95)"""
_SCORED_VIEWS = "places covers ancestors"
_CURVE = """d AS (SELECT geo_id, cos(radians(lat)) * cos(radians(lng)) AS x, cos(radians(lat)) * sin(radians(lng)) AS y, sin(radians(lat)) AS z FROM points),
    f AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS face FROM d),
    uv AS (SELECT geo_id, face, CASE face WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u,
        CASE face WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v FROM f),
    g AS (SELECT geo_id, face, CAST(floor((CASE WHEN u >= 0 THEN 0.5 * sqrt(1 + 3 * u) ELSE 1 - 0.5 * sqrt(1 - 3 * u) END) * 1073741824) AS BIGINT) AS i,
        CAST(floor((CASE WHEN v >= 0 THEN 0.5 * sqrt(1 + 3 * v) ELSE 1 - 0.5 * sqrt(1 - 3 * v) END) * 1073741824) AS BIGINT) AS j FROM uv),
    h AS (SELECT geo_id, i, j, face & 1 AS o, CAST(face AS BIGINT) AS p, 0 AS level FROM g
        UNION ALL SELECT geo_id, i, j, xor(o, [1, 0, 0, 3][q + 1]), p * 4 + q, level + 1 FROM (
            SELECT *, list_position([[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]][o + 1], CAST(((i >> (29 - level)) & 1) * 2 + ((j >> (29 - level)) & 1) AS INTEGER)) - 1 AS q FROM h WHERE level < 20)),
    at_level AS (SELECT geo_id, level, rtrim(lpad(format('{:x}', CAST((p::HUGEINT * 2 + 1) * (1::HUGEINT << (2 * (30 - level))) AS UBIGINT)), 16, '0'), '0') AS token FROM h)"""

ORACLE_SQL = {
    "cell_levels": sql(_COVERS, f"SELECT owner, {_TOKEN} AS token, {_LEVEL} AS level, cell & -cell AS leaves FROM covers"),
    "cell_ancestors": sql("places covers ancestors", f"SELECT owner, {_TOKEN} AS token, {_HEX.format('up')} AS ancestor, CAST(l AS INTEGER) AS level FROM ancestors"),
    "cell_children": sql("region_cells", f"k AS (SELECT region_id, cell + unnest([-3, -1, 1, 3]) * ((cell & -cell) >> 2) AS cell FROM region_cells) SELECT region_id, {_TOKEN} AS token, {_LEVEL} AS level FROM k"),
    "cover_leaf_area": sql(_COVERS, "SELECT owner, CAST(sum(cell & -cell) AS BIGINT) AS leaves, count(*) AS n_cells FROM covers GROUP BY owner"),
    "blocking_keys": sql(_COVERS, f"k AS (SELECT DISTINCT owner, {_KEY} AS cell FROM covers) SELECT owner, {_TOKEN} AS key FROM k"),
    "point_cells": sql("points", f"{_CURVE} SELECT geo_id, max(token) FILTER (level = 8) AS l8, max(token) FILTER (level = 10) AS l10, max(token) FILTER (level = 13) AS l13, max(token) FILTER (level = 20) AS l20 FROM at_level GROUP BY geo_id"),
    "point_neighbours": sql("points", "SELECT geo_id, 9 AS n_cells, true AS own_inside FROM points"),
    "points_in_regions": sql("region_cells", """p AS (SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS geo_id, p_partkey * 2654435761 * 2 + 1 AS leaf FROM part)
        SELECT DISTINCT geo_id, region_id AS owner FROM p JOIN region_cells ON leaf BETWEEN cell - (cell & -cell) AND cell + (cell & -cell)"""),
    "blocking_candidates": sql(_COVERS, f"keys AS (SELECT DISTINCT owner, {_KEY} AS key FROM covers), pairs AS (SELECT DISTINCT x.owner AS a, y.owner AS b FROM keys x JOIN keys y ON x.key = y.key AND y.owner <> x.owner) SELECT a, count(*) AS candidates, min(b) AS first FROM pairs GROUP BY a"),
    "cover_iou_pairs": sql(_SCORED_VIEWS, f"{_SCORED} SELECT a, b, shared, leaves_a, leaves_b, iou FROM scored WHERE iou > 0"),
    "cover_containment_pairs": sql(_SCORED_VIEWS, f"{_SCORED} SELECT a, b, containment FROM scored WHERE containment >= 0.95"),
    "token_overlap_pct": sql(_COVERS, f"""t AS (SELECT owner, list(DISTINCT {_TOKEN}) AS t FROM covers GROUP BY owner),
        p AS (SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS a, 'P' || lpad(CAST(p_partkey - p_partkey % 5 AS VARCHAR), 10, '0') AS b FROM part)
        SELECT a, b, CASE WHEN len(x.t) > 0 AND len(y.t) > 0 THEN round(100.0::DOUBLE * len(list_intersect(x.t, y.t)) / greatest(len(x.t), len(y.t)), 2) ELSE 0.0 END AS percent
        FROM p LEFT JOIN t x ON x.owner = a LEFT JOIN t y ON y.owner = b"""),
    "overlap_two_plots": sql(_SCORED_VIEWS, f"""{_SCORED}, two AS (SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS a, 'P' || lpad(CAST(p_partkey + 1 AS VARCHAR), 10, '0') AS b FROM part)
        SELECT two.a, two.b, coalesce(iou, 0.0::DOUBLE) AS iou, coalesce(containment, 0.0::DOUBLE) AS containment FROM two LEFT JOIN scored ON scored.a = two.b AND scored.b = two.a"""),
    "cover_intersections": sql(_SCORED_VIEWS, f"""{_SCORED}, fine AS (SELECT DISTINCT h.a, h.b, h.cell FROM hits h JOIN pairs p ON p.a = h.a AND p.b = h.b),
        -- Four children of one cell are that cell; covers here have two levels, so one step is enough.
        up AS (SELECT *, (cell & -((cell & -cell) << 2)) | ((cell & -cell) << 2) AS above FROM fine),
        whole AS (SELECT DISTINCT a, b, CASE WHEN count(*) OVER (PARTITION BY a, b, above) = 4 THEN above ELSE cell END AS cell FROM up)
        SELECT a, b, count(*) AS n_cells, CAST(sum(cell & -cell) AS BIGINT) AS leaves, min({_TOKEN}) AS first_cell FROM whole GROUP BY a, b"""),
    "resolve_best": sql(_SCORED_VIEWS, f"{_SCORED} SELECT a, b, relation, score FROM passed QUALIFY row_number() OVER (PARTITION BY a ORDER BY relation <> 'same_as', score DESC, b) = 1"),
    "resolve_earliest": sql(_SCORED_VIEWS, f"{_SCORED} SELECT a, b, relation, score FROM passed QUALIFY row_number() OVER (PARTITION BY a ORDER BY relation <> 'same_as', b DESC) = 1"),
    "point_distance_join": sql("points", """p AS (SELECT geo_id, lat + 0.00002 AS lat, lng FROM points),
        m AS (SELECT p.geo_id AS a, q.geo_id AS b, 2 * 6371010.0 * asin(least(1.0, sqrt(pow(sin((radians(q.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin((radians(q.lng) - radians(p.lng)) / 2), 2)))) AS metres
            FROM p JOIN points q ON abs(p.lat - q.lat) < 0.0002 AND abs(p.lng - q.lng) < 0.0002)
        SELECT a, b, round(metres, 3) AS metres FROM m WHERE metres <= 10"""),
}
