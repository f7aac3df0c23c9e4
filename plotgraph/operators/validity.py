"""Shapes whose rings cross, touch or overlap, made into simple polygons of the same points by the even-odd rule.

All shapes' edges are noded together: edges of one shape meet by equality of
grid blocks, are cut where they cross or touch, and pieces that occur an even
number of times cancel.  Coordinates are whole millionths of a degree, so tests
of sides are exact.  Only the last step, walking round the faces of what is
left, is done shape by shape.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.lineage import cut

UNIT = 1_000_000


def edges_of(plots: DataFrame) -> DataFrame:
    """``owner, e, x0, y0, x1, y1``: the edges of ``plots(owner, shape)`` in whole units, without those of no length."""
    whole = lambda v: F.round(v * UNIT).cast("long")
    rings = plots.select("owner", F.explode(F.flatten("shape")).alias("r"))
    dots = rings.select("owner", F.transform("r", lambda p: F.struct(whole(p[0]).alias("x"), whole(p[1]).alias("y"))).alias("r"))
    ring = F.array_compact("r")
    dots = dots.select("owner", ring.alias("r")).filter(F.size("r") > 1)
    turned = F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1))
    legs = dots.select("owner", F.explode(F.arrays_zip(F.col("r").alias("p"), turned.alias("q"))).alias("leg"))
    flat = legs.select("owner", F.col("leg.p.x").alias("x0"), F.col("leg.p.y").alias("y0"), F.col("leg.q.x").alias("x1"), F.col("leg.q.y").alias("y1"))
    return flat.filter("x0 <> x1 or y0 <> y1").withColumn("e", F.monotonically_increasing_id())


def blocked(edges: DataFrame) -> DataFrame:
    """The edges with the blocks ``bx, by`` they pass through: of each shape's box about as many as it has edges."""
    box = edges.groupBy("owner").agg(F.count("*").alias("n"), F.min(F.least("x0", "x1")).alias("west"), F.min(F.least("y0", "y1")).alias("south"), F.max(F.greatest("x0", "x1")).alias("east"), F.max(F.greatest("y0", "y1")).alias("north"))
    step = lambda lo, hi: F.greatest(F.lit(1).cast("long"), F.ceil((F.col(hi) - F.col(lo) + 1) / F.ceil(F.sqrt("n"))))
    rows = edges.join(box.select("owner", "west", "south", step("west", "east").alias("w"), step("south", "north").alias("h")), "owner")
    at = lambda v, low, size: F.floor((v - F.col(low)) / F.col(size))
    left, right = F.least("x0", "x1"), F.greatest("x0", "x1")
    rows = rows.withColumn("bx", F.explode(F.sequence(at(left, "west", "w"), at(right, "west", "w"))))
    # Where the edge is within this strip, a unit more on either side.
    low, high = F.col("west") + F.col("bx") * F.col("w") - 1, F.col("west") + (F.col("bx") + 1) * F.col("w") + 1
    y = lambda x: F.col("y0") + (F.col("y1") - F.col("y0")) * ((x - F.col("x0")) / (F.col("x1") - F.col("x0")))
    upright = F.col("x0") == F.col("x1")
    ends = [F.when(upright, F.col(v)).otherwise(y(F.greatest(low, left) if v == "y0" else F.least(high, right))) for v in ("y0", "y1")]
    bottom, top = F.greatest(F.least(*ends) - 1, F.least("y0", "y1")), F.least(F.greatest(*ends) + 1, F.greatest("y0", "y1"))
    rows = rows.withColumn("by", F.explode(F.sequence(at(bottom, "south", "h"), at(top, "south", "h"))))
    return rows.select("owner", "e", "x0", "y0", "x1", "y1", "bx", "by")


def cuts(edges: DataFrame) -> DataFrame:
    """``owner, e, x, y``: points inside edges where another edge of the shape crosses or touches them."""
    b = blocked(edges)
    names = ("e", "x0", "y0", "x1", "y1")
    other = b.select("owner", "bx", "by", *[F.col(c).alias(f"o{c}") for c in names])
    pairs = b.join(other, ["owner", "bx", "by"]).filter("e < oe").select("owner", *names, *[f"o{c}" for c in names])
    side = lambda ax, ay, bx, by, px, py: (F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax))
    mine, theirs = ("x0", "y0", "x1", "y1"), ("ox0", "oy0", "ox1", "oy1")
    pairs = pairs.withColumns({"s0": side(*mine, "ox0", "oy0"), "s1": side(*mine, "ox1", "oy1"), "t0": side(*theirs, "x0", "y0"), "t1": side(*theirs, "x1", "y1")})

    def touch(edge: str, line: tuple[str, ...], at: str, x: str, y: str) -> Column:
        """A cut where the end ``x, y`` of the other edge lies on the edge ``line``."""
        x0, y0, x1, y1 = map(F.col, line)
        within = F.col(x).between(F.least(x0, x1), F.greatest(x0, x1)) & F.col(y).between(F.least(y0, y1), F.greatest(y0, y1))
        return F.when((F.col(at) == 0) & within, F.struct(F.col(edge).alias("e"), F.col(x).alias("x"), F.col(y).alias("y")))

    crossing = (F.signum("s0") * F.signum("s1") < 0) & (F.signum("t0") * F.signum("t1") < 0)
    t = F.col("t0").cast("double") / (F.col("t0").cast("double") - F.col("t1").cast("double"))
    x, y = F.col("x0") + F.round(t * (F.col("x1") - F.col("x0"))).cast("long"), F.col("y0") + F.round(t * (F.col("y1") - F.col("y0"))).cast("long")
    met = lambda edge: F.when(crossing, F.struct(F.col(edge).alias("e"), x.alias("x"), y.alias("y")))
    found = F.array(met("e"), met("oe"), touch("e", mine, "s0", "ox0", "oy0"), touch("e", mine, "s1", "ox1", "oy1"), touch("oe", theirs, "t0", "x0", "y0"), touch("oe", theirs, "t1", "x1", "y1"))
    points = pairs.select("owner", F.explode(F.array_compact(found)).alias("c")).select("owner", "c.*").distinct()
    ends = edges.select("owner", "e", *mine)
    return points.join(ends, ["owner", "e"]).filter("(x <> x0 or y <> y0) and (x <> x1 or y <> y1)").select("owner", "e", "x", "y")


def pieces(edges: DataFrame, cut_at: DataFrame) -> DataFrame:
    """``owner, x0, y0, x1, y1``: edges cut in pieces; of pieces that occur several times, one if their number is odd and none if it is even."""
    inner = cut_at.groupBy("owner", "e").agg(F.collect_list(F.struct("x", "y")).alias("inner"))
    rows = edges.join(inner, ["owner", "e"], "left")
    far = lambda p: (p["x"] - F.col("x0")) * (p["x"] - F.col("x0")) + (p["y"] - F.col("y0")) * (p["y"] - F.col("y0"))
    along = F.transform(F.array_sort(F.transform(F.coalesce("inner", F.array().cast("array<struct<x:bigint,y:bigint>>")), lambda p: F.struct(far(p).alias("far"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    at = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    path = F.concat(at("x0", "y0"), along, at("x1", "y1"))
    legs = rows.select("owner", path.alias("path")).select("owner", F.explode(F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")), lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")))).alias("leg"))
    legs = legs.filter("leg.p <> leg.q").groupBy("owner", "leg").agg((F.count("*") % 2).alias("odd"), F.count("*").alias("n"))
    return legs.select("owner", F.col("leg.p.x").alias("x0"), F.col("leg.p.y").alias("y0"), F.col("leg.q.x").alias("x1"), F.col("leg.q.y").alias("y1"), "odd", "n")


def _inside(ring: list[tuple[int, int]], p: tuple[int, int]) -> bool:
    """Whether a point that isn't on the ring lies in it."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > p[1]) != (by > p[1]):
            s = (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
            odd ^= (s > 0) == (by > ay)
    return odd


def _simple(walk: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """The simple rings of a closed walk that may touch itself in points."""
    path: list[tuple[int, int]] = []
    at: dict[tuple[int, int], int] = {}
    for p in walk:
        if p in at:
            yield path[at[p] :]
            for q in path[at[p] + 1 :]:
                del at[q]
            del path[at[p] + 1 :]
        else:
            at[p] = len(path)
            path.append(p)
    yield path


def faces(edges: list[tuple[int, int, int, int]]) -> list[list[list[tuple[int, int]]]]:
    """Polygons (an outer ring, then holes) of the points that edges without crossings enclose an odd number of times."""
    near = defaultdict(list)
    for ax, ay, bx, by in edges:
        near[ax, ay].append((bx, by))
        near[bx, by].append((ax, ay))
    after = {}
    for p, ends in near.items():
        ends.sort(key=lambda q: math.atan2(q[1] - p[1], q[0] - p[0]))
        for i, q in enumerate(ends):
            after[q, p] = ends[i - 1]  # coming from q, the next edge clockwise: the face stays on the left
    face, walks = {}, []
    for start in after:
        if start in face:
            continue
        walk, (a, b) = [], start
        while (a, b) not in face:
            face[a, b] = len(walks)
            walk.append(a)
            a, b = b, after[a, b]
        walks.append(walk)
    area = [sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(w, w[1:] + w[:1])) for w in walks]
    # Faces on two sides of an edge differ; the outer face of a connected part is the one that is walked clockwise.
    odd: dict[int, bool] = {}
    beside = defaultdict(set)
    for (a, b), f in face.items():
        beside[f].add(face[b, a])
    outer = [f for f in range(len(walks)) if area[f] < 0]
    for f in outer:
        corner = min(walks[f])
        odd[f] = _depth(corner, edges) % 2 == 1
        todo = [f]
        while todo:
            g = todo.pop()
            for h in beside[g]:
                if h not in odd:
                    odd[h] = not odd[g]
                    todo.append(h)
    shells, holes = [], []
    for f, walk in enumerate(walks):
        if odd.get(f):
            for ring in _simple(walk):
                turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))
                if turn:
                    (shells if turn > 0 else holes).append((abs(turn), ring))
    shells.sort(key=lambda s: s[0])
    polygons = [[ring] for _, ring in shells]
    for _, hole in holes:
        # A corner that isn't the shell's too; the smallest shell around it has the hole.
        for polygon in polygons:
            corners = set(polygon[0])
            free = next((p for p in hole if p not in corners), None)
            if free is not None and _inside(polygon[0], free):
                polygon.append(hole)
                break
    return polygons


def _depth(corner: tuple[int, int], edges: list[tuple[int, int, int, int]]) -> int:
    """How many edges lie straight west of a part's westernmost corner: none are its own."""
    n = 0
    for ax, ay, bx, by in edges:
        if (ay > corner[1]) != (by > corner[1]):
            s = (bx - ax) * (corner[1] - ay) - (by - ay) * (corner[0] - ax)
            n += s != 0 and (s < 0) == (by > ay)
    return n


def _rebuilt(edges: pd.Series) -> pd.Series:
    degrees = lambda ring: [[p[0] / UNIT, p[1] / UNIT] for p in [*ring, ring[0]]]
    return pd.Series([[[degrees(r) for r in polygon] for polygon in faces([(e["x0"], e["y0"], e["x1"], e["y1"]) for e in row])] for row in edges])


def make_valid(plots: DataFrame) -> DataFrame:
    """``owner, shape, repaired`` of ``plots(owner, shape)``: rings that cross, touch themselves or overlap become simple ones around the same points.

    A point belongs to the result if the rings go round it an odd number of
    times; overlapping parts and doubled edges are read the same way.  Shapes
    that are sound already are as they were (``repaired`` is false).  Owners are
    unique.  Null and empty shapes, points and lines (shapes of fewer than three
    edges, or without area) are as they were.
    """
    rows = plots.filter(F.size("shape") > 0)
    edges = cut(edges_of(rows))
    cut_at = cut(cuts(edges))
    parts = cut(pieces(edges, cut_at))
    corners = parts.filter("odd = 1").select("owner", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p"))
    crossing = cut_at.select("owner").unionByName(parts.filter("n > 1").select("owner"))
    # Rings that meet in a corner that all of them have: no edge is cut, but more than two edges end there.
    crossing = crossing.unionByName(corners.groupBy("owner", "p").agg(F.count("*").alias("ends")).filter("ends > 2").select("owner")).distinct()
    left = parts.filter("odd = 1").join(crossing, "owner", "left_semi").groupBy("owner").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("edges"))
    rebuilt = F.pandas_udf(_rebuilt, geometry.SHAPE)
    fresh = left.select("owner", rebuilt("edges").alias("fresh")).filter(F.size("fresh") > 0)
    out = plots.select("owner", "shape").join(fresh, "owner", "left")
    return out.select("owner", F.coalesce("fresh", "shape").alias("shape"), F.col("fresh").isNotNull().alias("repaired"))
