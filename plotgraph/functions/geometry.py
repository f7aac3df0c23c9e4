"""Plots' geometry as Column expressions over nested arrays of numbers.

A geometry is ``array<array<array<array<double>>>>``: polygons of rings of
``[lng, lat]`` points.  Points are one polygon of one ring of one point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import let

SHAPE = "array<array<array<array<double>>>>"
EARTH_METRES = 6_371_010.0
#: The ellipsoid of the equal-area projection (half axis in metres, squared eccentricity) and acres in a square kilometre.
AXIS, ECCENTRICITY2, ACRES_PER_KM2 = 6_378_137.0, 0.00669437999014, 247.105
HECTARES_PER_ACRE = 0.404686


def wkt_kind(wkt: Column) -> Column:
    return F.upper(F.regexp_extract(F.trim(wkt), r"^([A-Za-z]+)", 1))


def _coordinates(json: Column, kind: Column) -> Column:
    """Nested coordinates of any of the kinds as polygons; null for other kinds or unreadable numbers."""
    at = lambda depth: F.from_json(json, depth)
    point = at("array<double>")
    return (
        F.when(kind == "POINT", F.when(F.size(point) >= 2, F.array(F.array(F.array(point)))))
        .when(kind == "LINESTRING", F.array(F.array(at("array<array<double>>"))))
        .when(kind == "POLYGON", F.array(at("array<array<array<double>>>")))
        .when(kind == "MULTIPOLYGON", at(SHAPE))
    )


def from_wkt(wkt: Column) -> Column:
    """Polygons of a POINT, LINESTRING, POLYGON or MULTIPOLYGON; heights are dropped; null if it can't be read."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    body = F.regexp_extract(wkt, r"^\s*[A-Za-z]+\s*(?:[Zz]\s*)?(\(.*\))\s*$", 1)
    pairs = F.regexp_replace(body, rf"{number}\s+{number}(?:\s+{number})?", "[$1,$2]")
    nested = F.translate(pairs, "()", "[]")
    kind = wkt_kind(wkt)
    # A point's coordinates stand in brackets of their own once more.
    text = F.when(kind == "POINT", F.regexp_replace(nested, r"^\[\s*(\[.*\])\s*\]$", "$1")).otherwise(nested)
    return F.when(F.length(body) > 0, _coordinates(text, kind))


def from_geojson(geometry: Column) -> Column:
    """As ``from_wkt``, from a GeoJSON geometry's text."""
    return _coordinates(F.get_json_object(geometry, "$.coordinates"), F.upper(F.get_json_object(geometry, "$.type")))


def _fold(ring: Column, term) -> Column:
    """Sum of ``term(p, q)`` over the ring's edges, the closing one included."""
    return F.aggregate(F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), term), F.lit(0.0), lambda s, x: s + x)


def signed_area(ring: Column) -> Column:
    """Planar area in square degrees, positive if counter-clockwise."""
    return _fold(ring, lambda p, q: (p[0] * q[1] - q[0] * p[1]) / 2)


def is_closed_point(shape: Column) -> Column:
    """Whether all vertices coincide at six decimals: a pin, however it was written."""
    points = F.flatten(F.flatten(shape))
    return F.size(F.array_distinct(F.transform(points, lambda p: F.struct(F.round(p[0], 6), F.round(p[1], 6))))) == 1


def canonical(shape: Column) -> Column:
    """Rings rounded to six decimals, without repeated vertices or empty rings, from their smallest vertex; outer rings counter-clockwise, holes clockwise, closed; polygons without area are dropped.

    Self-crossing rings are kept as they are; covers read them by the even-odd rule.
    """

    def ring(r: Column, outer: Column) -> Column:
        rounded = F.transform(r, lambda p: F.array(F.round(p[0], 6), F.round(p[1], 6)))
        fresh = F.filter(rounded, lambda p, i: (i == 0) | (p != F.get(rounded, i - 1)))
        opened = let(fresh, lambda f: F.when((F.size(f) > 1) & (F.element_at(f, 1) == F.element_at(f, -1)), F.slice(f, 1, F.size(f) - 1)).otherwise(f))
        turned = let(opened, lambda o: F.when((signed_area(o) > 0) == outer, o).otherwise(F.reverse(o)))
        first = lambda x: F.array_position(x, F.array_min(x)).cast("int")
        started = let(turned, lambda x: F.when(F.size(x) > 1, F.concat(F.slice(x, first(x), F.size(x)), F.slice(x, F.lit(1), first(x) - 1))).otherwise(x))
        return let(started, lambda x: F.concat(x, F.slice(x, 1, 1)))

    polygons = F.transform(shape, lambda rings: F.transform(rings, lambda r, i: ring(r, i == 0)))
    off_line = lambda r: F.exists(r, lambda p: F.abs((r[1][0] - r[0][0]) * (p[1] - r[0][1]) - (r[1][1] - r[0][1]) * (p[0] - r[0][0])) > 1e-15)
    sound = F.transform(polygons, lambda rings: F.filter(rings, lambda r: (F.size(r) >= 4) & off_line(r)))
    return F.filter(sound, lambda rings: F.size(rings) > 0)


def usable(wkt: Column, shape: Column) -> Column:
    """Why a geometry can't be used as a polygon, or null: ``no_geometry``, ``unparseable``, ``not_polygonal`` or ``zero_area``."""
    return (
        F.when(F.coalesce(F.length(F.trim(wkt)), F.lit(0)) == 0, "no_geometry")
        .when(shape.isNull() & wkt_kind(wkt).isin("POINT", "LINESTRING", "POLYGON", "MULTIPOLYGON"), "unparseable")
        .when(shape.isNull(), "unparseable")
        .when(~wkt_kind(wkt).isin("POLYGON", "MULTIPOLYGON"), "not_polygonal")
        .when(F.size(canonical(shape)) == 0, "zero_area")
    )


def altered(shape: Column) -> Column:
    """Whether canonicalising changes a polygon: another number of parts, an area off by more than one in a billion, or a shape that can't be read."""
    whole = canonical(shape)
    before, after = total_area(shape), total_area(whole)
    return F.coalesce((F.size(whole) != F.size(shape)) | (F.abs(after - before) > 1e-9 * F.greatest(before, F.lit(1e-300))), F.lit(True))


def total_area(shape: Column) -> Column:
    """Planar area in square degrees, holes taken off."""
    return F.aggregate(shape, F.lit(0.0), lambda s, rings: s + F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0) * F.abs(signed_area(r))), F.lit(0.0), lambda a, x: a + x))


def centroid(shape: Column) -> Column:
    """``lng, lat`` of the planar centroid; of a geometry without area, the mean of its vertices."""

    def ring(r: Column, i: Column) -> Column:
        sign = F.when(i == 0, 1.0).otherwise(-1.0)
        a = signed_area(r)
        turn = F.when(a < 0, -1.0).otherwise(1.0) * sign
        cross = lambda k: _fold(r, lambda p, q: (p[k] + q[k]) * (p[0] * q[1] - q[0] * p[1]) / 6)
        return F.struct((turn * a).alias("a"), (turn * cross(0)).alias("x"), (turn * cross(1)).alias("y"))

    parts = F.flatten(F.transform(shape, lambda rings: F.transform(rings, ring)))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(parts, zero, lambda s, p: F.struct((s["a"] + p["a"]).alias("a"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
    points = F.flatten(F.flatten(shape))
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / F.size(points)
    flat = F.struct(mean(0).alias("lng"), mean(1).alias("lat"))
    return let(total, lambda t: F.when(F.abs(t["a"]) > 1e-18, F.struct((t["x"] / t["a"]).alias("lng"), (t["y"] / t["a"]).alias("lat"))).otherwise(flat))


def contains(shape: Column, lng: Column, lat: Column) -> Column:
    """Whether a point lies inside, by the even-odd rule over all rings."""

    def crossings(r: Column) -> Column:
        hit = lambda p, q: F.when(((p[1] > lat) != (q[1] > lat)) & (lng < (q[0] - p[0]) * (lat - p[1]) / (q[1] - p[1]) + p[0]), 1.0).otherwise(0.0)
        return _fold(r, hit)

    return F.aggregate(F.flatten(shape), F.lit(0.0), lambda s, r: s + crossings(r)) % 2 == 1


def sphere_hectares(shape: Column) -> Column:
    """Area on a sphere whose edges are great circles, holes taken off."""

    def ring(r: Column) -> Column:
        def edge(p: Column, q: Column) -> Column:
            a, b = F.tan(F.radians(p[1]) / 2), F.tan(F.radians(q[1]) / 2)
            return 2 * F.atan2(F.tan(F.radians(q[0] - p[0]) / 2) * (a + b), 1 + a * b)

        return F.abs(_fold(r, edge)) * EARTH_METRES * EARTH_METRES / 10_000

    return F.aggregate(shape, F.lit(0.0), lambda s, rings: s + F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0) * ring(r)), F.lit(0.0), lambda a, x: a + x))


def equal_area_acres(shape: Column) -> Column:
    """Acres in an equal-area conic projection whose parallels are the geometry's least and greatest latitude."""
    e = ECCENTRICITY2**0.5

    def q(sin: Column) -> Column:
        return (1 - ECCENTRICITY2) * (sin / (1 - ECCENTRICITY2 * sin * sin) - F.log((1 - e * sin) / (1 + e * sin)) / (2 * e))

    def m2(sin: Column) -> Column:
        return (1 - sin * sin) / (1 - ECCENTRICITY2 * sin * sin)

    def area(c: Column) -> Column:
        flat = F.abs(c["q2"] - c["q1"]) < 1e-15
        n = F.when(flat, F.sin(F.radians(c["low"]))).otherwise((c["m1"] - c["m2"]) / (c["q2"] - c["q1"]))
        constants = F.struct(n.alias("n"), (c["m1"] + n * c["q1"]).alias("c"))

        def project(k: Column) -> Column:
            def point(p: Column) -> Column:
                rho = F.sqrt(F.greatest(F.lit(0.0), k["c"] - k["n"] * q(F.sin(F.radians(p[1]))))) / k["n"]
                return let(F.struct(rho.alias("rho"), (k["n"] * F.radians(p[0] - c["lng"])).alias("theta")), lambda s: F.array(s["rho"] * F.sin(s["theta"]), -s["rho"] * F.cos(s["theta"])))

            return total_area(F.transform(shape, lambda rings: F.transform(rings, lambda r: F.transform(r, point))))

        # Around the equator a cone has no apex: the cylinder's area is the conic's limit.
        cylinder = total_area(F.transform(shape, lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.array(F.radians(p[0]), q(F.sin(F.radians(p[1]))) / 2)))))
        return F.when(F.abs(n) < 1e-9, cylinder).otherwise(let(constants, project)) * AXIS * AXIS / 1e6 * ACRES_PER_KM2

    points = F.flatten(F.flatten(shape))
    lats = F.transform(points, lambda p: p[1])
    low, high = F.array_min(lats), F.array_max(lats)
    s1, s2 = F.sin(F.radians(low)), F.sin(F.radians(high))
    return let(F.struct(low.alias("low"), F.element_at(points, 1)[0].alias("lng"), q(s1).alias("q1"), q(s2).alias("q2"), m2(s1).alias("m1"), m2(s2).alias("m2")), area)


def to_geojson(shape: Column) -> Column:
    """GeoJSON text of polygons as a MultiPolygon."""
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), shape.alias("coordinates")))


def to_wkt(shape: Column) -> Column:
    """WKT of polygons, six decimals."""
    number = lambda x: F.format_string("%.6f", x)
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", number(p[0]), number(p[1]))), ", "), F.lit(")"))
    polygon = lambda rings: F.concat(F.lit("("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))
    return F.when(F.size(shape) == 1, F.concat(F.lit("POLYGON "), polygon(F.element_at(shape, 1)))).otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(shape, polygon), ", "), F.lit(")")))


def content_hash(shape: Column) -> Column:
    """SHA-256 over the canonical geometry's text: equal for equal plots, however they were written."""
    return F.sha2(to_wkt(canonical(shape)), 256)
