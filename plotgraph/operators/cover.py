"""Covers of polygons by descent through the cells, level by level.

On a cube face's plane great circles are straight and cells are rectangles, so
a polygon's relation to a cell is plane geometry.  All polygons go down
together: each round splits the cells that a polygon's edges cross and keeps
those that it touches; cells inside are done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, geometry
from ..functions.lineage import cut, spread


#: Least height over the plane through the sphere's middle at which a ring is cut; what lies beyond is far outside the face.
HORIZON = 1e-3
#: Polygons that a task begins with, and cells on the way down that it goes on with; all tasks are dealt anew every DEAL levels.
POLYGONS, CELLS, DEAL = 200, 10_000, 5


def _edges(shape: Column, face: Column) -> Column:
    """The rings' edges on a face's plane: ``x0, y0, x1, y1``; of a ring that goes behind the face, the part before it, closed far outside the face."""

    def flat(p: Column) -> Column:
        lam, phi = F.radians(p[0]), F.radians(p[1])
        a, b, h = cells.onto(face, F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
        return F.struct(a.alias("a"), b.alias("b"), h.alias("h"))

    def before(p: Column, q: Column) -> Column:
        """The start of the edge if it lies before the face, and where the edge crosses the horizon."""
        t = (HORIZON - p["h"]) / (q["h"] - p["h"])
        cut_at = F.struct((p["a"] + t * (q["a"] - p["a"])).alias("a"), (p["b"] + t * (q["b"] - p["b"])).alias("b"), F.lit(HORIZON).alias("h"))
        seen = lambda x: x["h"] >= HORIZON
        none = F.array().cast("array<struct<a:double,b:double,h:double>>")
        return F.concat(F.when(seen(p), F.array(p)).otherwise(none), F.when(seen(p) != seen(q), F.array(cut_at)).otherwise(none))

    def ring(r: Column) -> Column:
        on = F.transform(r, flat)
        clipped = cells.let(on, lambda o: F.flatten(F.zip_with(F.slice(o, 1, F.size(o) - 1), F.slice(o, 2, F.size(o) - 1), before)))
        at = lambda p: F.struct((p["a"] / p["h"]).alias("x"), (p["b"] / p["h"]).alias("y"))
        closed = cells.let(clipped, lambda c: F.when(F.size(c) > 0, F.transform(F.concat(c, F.slice(c, 1, 1)), at)).otherwise(F.array().cast("array<struct<x:double,y:double>>")))
        return cells.let(closed, lambda o: F.when(F.size(o) > 1, F.zip_with(F.slice(o, 1, F.size(o) - 1), F.slice(o, 2, F.size(o) - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")))

    return F.flatten(F.transform(F.flatten(shape), ring))


def _turns(edges: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
    """Whether one of two points is inside and the other isn't, if all edges that the way between them meets are among ``edges``: first along x, then along y."""
    across = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & ((x < _at_y(e, y)) != (u < _at_y(e, y)))
    up = lambda e: ((e["x0"] > u) != (e["x1"] > u)) & ((y < _at_x(e, u)) != (v < _at_x(e, u)))
    return (F.size(F.filter(edges, across)) + F.size(F.filter(edges, up))) % 2 == 1


def _at_y(e: Column, y: Column) -> Column:
    return (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"]


def _at_x(e: Column, x: Column) -> Column:
    return (e["y1"] - e["y0"]) * (x - e["x0"]) / (e["x1"] - e["x0"]) + e["y0"]


def _inside(edges: Column, x: Column, y: Column) -> Column:
    hit = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])
    return F.size(F.filter(edges, hit)) % 2 == 1


def _crosses(b: Column, e: Column) -> Column:
    """Whether an edge has a point in the cell's closed rectangle: the part of the edge between the sides, in both directions, isn't empty."""
    dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
    big = F.lit(1e300)

    def span(start: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        within = (start >= lo) & (start <= hi)
        first = F.when(d > 0, (lo - start) / d).when(d < 0, (hi - start) / d).when(within, -big).otherwise(big)
        last = F.when(d > 0, (hi - start) / d).when(d < 0, (lo - start) / d).when(within, big).otherwise(-big)
        return first, last

    x_in, x_out = span(e["x0"], dx, b["u0"], b["u1"])
    y_in, y_out = span(e["y0"], dy, b["v0"], b["v1"])
    return F.greatest(x_in, y_in, F.lit(0.0)) <= F.least(x_out, y_out, F.lit(1.0))


def polygon_cover(plots: DataFrame, finest: int = 20) -> DataFrame:
    """``owner, cell``: the normalised cover of every polygon ``plots(owner, shape)``.

    ``shape`` is canonical (see ``geometry.canonical``).  A cell is kept where
    the polygon contains it, or at level ``finest`` where it touches it; holes
    and all parts count, crossing rings by the even-odd rule.  Rings are cut at
    each face's horizon, so a polygon is seen on every face that it touches, if
    it is smaller than half the sphere.  A cell on the way down carries only the
    edges that cross it, where on its face it is, and whether its middle is
    inside.  Null or empty shapes have no cells.  Cells of one polygon are
    disjoint as they are found; only those of owners with several rows are
    compared.
    """

    def whole(face: Column) -> Column:
        cell = F.call_function("shiftleft", face.cast("long"), F.lit(61)).bitwiseOR(F.lit(1 << 60))
        zero = F.lit(0).cast("long")
        return F.struct(cell.alias("cell"), F.struct(F.lit(-1.0).alias("u0"), F.lit(1.0).alias("u1"), F.lit(-1.0).alias("v0"), F.lit(1.0).alias("v1")).alias("b"), face.bitwiseAND(1).cast("int").alias("o"), zero.alias("i"), zero.alias("j"), _edges(F.col("shape"), face).alias("edges"))

    def quarters(at: int) -> Column:
        """The four cells below, at level ``at``: a step down the curve from where the cell is."""
        edge = lambda a: cells.st_to_uv(a.cast("double") / (1 << at))
        step = F.array(*[F.array(*[F.struct(F.lit(q >> 1).alias("i"), F.lit(q & 1).alias("j"), F.lit(o ^ cells.TURN[k]).alias("o")) for k, q in enumerate(row)]) for o, row in enumerate(cells.POSITION_TO_QUADRANT)])

        def quarter(cell: Column, s: Column) -> Column:
            placed = F.struct((F.col("i") * 2 + s["i"]).alias("i"), (F.col("j") * 2 + s["j"]).alias("j"))
            bound = lambda p: F.struct(edge(p["i"]).alias("u0"), edge(p["i"] + 1).alias("u1"), edge(p["j"]).alias("v0"), edge(p["j"] + 1).alias("v1"))
            return cells.let(placed, lambda p: F.struct(cell.alias("cell"), bound(p).alias("b"), s["o"].alias("o"), p["i"].alias("i"), p["j"].alias("j")))

        return F.zip_with(cells.children(F.col("cell")), F.element_at(step, F.col("o") + 1), quarter)

    middle = lambda b: ((b["u0"] + b["u1"]) / 2, (b["v0"] + b["v1"]) / 2)
    plots = spread(plots.select("owner", "shape"), POLYGONS)
    place = ["o", "i", "j"]
    # What explode makes is computed once, however often it is named.
    faces = plots.filter(F.size("shape") > 0).select("owner", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), whole)).alias("c"))
    rows = faces.select("owner", "c.cell", "c.b", *[f"c.{x}" for x in place], "c.edges", _inside(F.col("c.edges"), *middle(F.col("c.b"))).alias("inside"))
    done: list[DataFrame] = []
    for at in range(finest + 1):
        crossing = rows.withColumn("edges", F.filter("edges", lambda e: _crosses(F.col("b"), e)))
        state = cut(crossing.filter((F.size("edges") > 0) | F.col("inside")))
        if at == finest:
            done.append(state.select("owner", "cell"))
            break
        done.append(state.filter(F.size("edges") == 0).select("owner", "cell"))
        state = state.filter(F.size("edges") > 0)
        if at and at % DEAL == 0:
            state = spread(state, max(1, CELLS >> DEAL))
        below = state.select("owner", "edges", "inside", F.col("b").alias("above"), F.explode(quarters(at + 1)).alias("c"))
        turns = _turns(F.col("edges"), *middle(F.col("above")), *middle(F.col("c.b")))
        rows = below.select("owner", "c.cell", "c.b", *[f"c.{x}" for x in place], "edges", (F.col("inside") != turns).alias("inside"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    several = cut(plots.groupBy("owner").agg(F.count("*").alias("n")).filter("n > 1").select("owner"))
    if not several.isEmpty():
        mine = several["owner"].eqNullSafe(out["owner"])
        out = out.join(several, mine, "left_anti").unionByName(cells.drop_covered(out.join(several, mine, "left_semi")))
    return cells.merge(out)


def with_identity(plots: DataFrame, finest: int = 20) -> DataFrame:
    """``owner, geo_id, geo_id_short, content_hash, n_cells`` of ``plots(owner, shape)``: the identity is the digest of the cover's tokens."""
    from ..functions import digests

    whole = plots.select("owner", geometry.canonical(F.col("shape")).alias("shape"))
    tokens = polygon_cover(whole, finest).groupBy("owner").agg(F.collect_set(cells.id_to_token(F.col("cell"))).alias("t"))
    identity = digests.cover_digest(F.col("t"))
    hashes = whole.select("owner", geometry.content_hash(F.col("shape")).alias("content_hash"))
    return tokens.select("owner", identity.alias("geo_id"), digests.short_id(identity).alias("geo_id_short"), F.size("t").cast("long").alias("n_cells")).join(hashes, "owner")


def point_identity(points: DataFrame) -> DataFrame:
    """``geo_id, cell, content_hash`` per ``points(owner, lng, lat)``: a point's identity is the digest of its leaf's token, so it can be inverted by trying leaves."""
    from ..functions import digests

    leaf = cells.from_lat_lng(F.round("lat", 6), F.round("lng", 6))
    text = F.concat_ws(" ", F.format_string("%.6f", F.col("lng")), F.format_string("%.6f", F.col("lat")))
    return points.select("owner", leaf.alias("cell"), digests.cover_digest(F.array(cells.id_to_token(leaf))).alias("geo_id"), F.sha2(text, 256).alias("content_hash"))


def box_cover(points: DataFrame, level: int) -> DataFrame:
    """``owner, cell``: cells of one level that the bounding box ``points(owner, west, south, east, north)`` touches."""
    shape = F.array(F.array(F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])))
    fine = polygon_cover(points.select("owner", shape.alias("shape")), level)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(2 * (30 - level)))
    n = cells.lowest_bit(F.col("cell")) / step
    low = F.col("cell") - cells.lowest_bit(F.col("cell")) + step
    return fine.select("owner", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda k: low + k * 2 * step)).alias("cell"))
