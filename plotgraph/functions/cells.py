"""Hierarchical cells of the sphere as Column expressions.

A cell id is a 64-bit number: three bits of cube face, the position on that
face's Hilbert curve, and a closing 1 bit that marks the level (0 to 30).  Ids
are LongType in two's complement; tokens are their hex digits without trailing
zeros, which sort like unsigned ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

MAX_LEVEL = 30
SIZE = 1 << MAX_LEVEL

#: The quadrant (i bit * 2 + j bit) at each position of the Hilbert curve, for each of four orientations.
POSITION_TO_QUADRANT = ((0, 1, 3, 2), (0, 2, 3, 1), (3, 2, 0, 1), (3, 1, 0, 2))
#: Its inverse.
QUADRANT_TO_POSITION = tuple(tuple(row.index(q) for q in range(4)) for row in POSITION_TO_QUADRANT)
#: How the orientation changes in the quadrant at each position.
TURN = (1, 0, 0, 3)
#: Levels that one step down the curve takes; the tables of such steps hold 4 * 4 ** BITS numbers.
BITS = 5


def _steps() -> tuple[list[int], list[int]]:
    """BITS levels at once: by orientation and (i, j) bits the position and the new orientation, ``position * 4 + orientation``; and by orientation and position ``(i, j) bits * 4 + orientation``."""
    to_position, to_bits = [0] * (4 << 2 * BITS), [0] * (4 << 2 * BITS)
    for start in range(4):
        for position in range(1 << 2 * BITS):
            o, i, j = start, 0, 0
            for k in range(BITS - 1, -1, -1):
                at = position >> 2 * k & 3
                q = POSITION_TO_QUADRANT[o][at]
                i, j, o = i * 2 + (q >> 1), j * 2 + (q & 1), o ^ TURN[at]
            bits = i << BITS | j
            to_position[start << 2 * BITS | bits] = position * 4 + o
            to_bits[start << 2 * BITS | position] = bits * 4 + o
    return to_position, to_bits


TO_POSITION, TO_BITS = _steps()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _table(numbers: list[int]) -> Column:
    """A constant array, written as one text that Spark reads once."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


# Tokens and ids.


def token_to_id(token: Column) -> Column:
    return F.conv(F.rpad(token, 16, "0"), 16, -10).cast("long")


def id_to_token(cell: Column) -> Column:
    return F.rtrim(F.lower(F.lpad(F.hex(cell), 16, "0")), F.lit("0"))


def lowest_bit(cell: Column) -> Column:
    return cell.bitwiseAND(-cell)


def leaf_count(cell: Column) -> Column:
    """Leaf cells in the cell: 4 ** (30 - level), which is the closing bit itself."""
    return lowest_bit(cell)


def level(cell: Column) -> Column:
    return (F.lit(MAX_LEVEL) - F.shiftright(F.bit_count(lowest_bit(cell) - 1), 1)).cast("int")


def token_level(token: Column) -> Column:
    return level(token_to_id(token))


def bit_of_level(at: Column) -> Column:
    """The closing bit of ids at a level."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (MAX_LEVEL - at)).cast("int"))


def parent(cell: Column, at: Column | int) -> Column:
    """The cell's ancestor at a level that isn't finer than its own."""
    if isinstance(at, int):
        bit = 1 << 2 * (MAX_LEVEL - at)
        return cell.bitwiseAND(F.lit(-bit)).bitwiseOR(F.lit(bit))
    return let(bit_of_level(at), lambda bit: cell.bitwiseAND(-bit).bitwiseOR(bit))


def ancestors(cell: Column, least: int = 0) -> Column:
    """The cell and all its ancestors down to level ``least``, coarsest first."""
    finest = level(cell)
    return F.when(finest >= least, F.transform(F.sequence(F.lit(least), finest), lambda at: parent(cell, at))).otherwise(F.array(cell))


def blocking_cells(cells: Column, at: int = 13) -> Column:
    """Distinct ancestors at level ``at``; coarser cells stay as they are."""
    return F.array_sort(F.array_distinct(F.transform(cells, lambda c: F.when(level(c) > at, parent(c, at)).otherwise(c))))


def children(cell: Column) -> Column:
    """The four cells of the next level, in curve order."""
    return F.array(*_kids(cell))


def _kids(cell: Column) -> list[Column]:
    step = F.shiftright(lowest_bit(cell), 2)
    return [cell + F.lit(k) * step for k in (-3, -1, 1, 3)]


# Positions on the sphere.


def _normal(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lng)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def face_of(x: Column, y: Column, z: Column) -> Column:
    a, b, c = F.abs(x), F.abs(y), F.abs(z)
    axis = F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)
    value = F.when(axis == 0, x).when(axis == 1, y).otherwise(z)
    return (axis + F.when(value < 0, 3).otherwise(0)).cast("int")


def project(face: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(u, v) of a direction on a face's plane; great circles are straight lines there."""
    u = F.when(face == 0, y / x).when(face == 1, -x / y).when(face == 2, -x / z).when(face == 3, z / x).when(face == 4, z / y).otherwise(-y / z)
    v = F.when(face == 0, z / x).when(face == 1, z / y).when(face == 2, -y / z).when(face == 3, y / x).when(face == 4, -x / y).otherwise(-x / z)
    return u, v


def onto(face: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(a, b, h) of a direction seen from a face: its height over the face's horizon, and (u, v) times that height; defined behind the face too."""
    a = F.when((face == 0) | (face == 5), y).when((face == 1) | (face == 2), -x).otherwise(-z)
    b = F.when(face <= 1, z).when(face <= 3, -y).otherwise(x)
    h = F.when(face == 0, x).when(face == 1, y).when(face == 2, z).when(face == 3, -x).when(face == 4, -y).otherwise(-z)
    return a, b, h


def unproject(face: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    one = F.lit(1.0)
    x = F.when(face == 0, one).when(face == 1, -u).when(face == 2, -u).when(face == 3, -one).when(face == 4, v).otherwise(v)
    y = F.when(face == 0, u).when(face == 1, one).when(face == 2, -v).when(face == 3, -v).when(face == 4, -one).otherwise(u)
    z = F.when(face == 0, v).when(face == 1, v).when(face == 2, one).when(face == 3, -u).when(face == 4, -u).otherwise(-one)
    return x, y, z


def _uv_to_st(u: Column) -> Column:
    return F.when(u >= 0, 0.5 * F.sqrt(1 + 3 * F.abs(u))).otherwise(1 - 0.5 * F.sqrt(1 + 3 * F.abs(u)))


def st_to_uv(s: Column) -> Column:
    return F.when(s >= 0.5, (4 * s * s - 1) / 3.0).otherwise((1 - 4 * (1 - s) * (1 - s)) / 3.0)


def _grid(u: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(SIZE - 1), F.floor(_uv_to_st(u) * SIZE))).cast("long")


def from_grid(face: Column, i: Column, j: Column) -> Column:
    """The leaf at (i, j) of a face: a walk down the curve, BITS levels a step."""
    table = _table(TO_POSITION)

    def walk(g: Column) -> Column:
        # The curve's position with the orientation in its two last bits.
        def step(s: Column, k: Column) -> Column:
            bits = lambda a: F.call_function("shiftright", a, k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
            at = F.shiftleft(s.bitwiseAND(F.lit(3)).cast("int"), 2 * BITS) + F.shiftleft(bits(g["i"]), BITS) + bits(g["j"]) + 1
            return F.shiftleft(s.bitwiseAND(F.lit(-4)), 2 * BITS).bitwiseOR(F.element_at(table, at).cast("long"))

        walked = F.aggregate(F.array(*map(F.lit, range(MAX_LEVEL - BITS, -1, -BITS))), g["face"].bitwiseAND(1).cast("long"), step)
        position = F.call_function("shiftright", walked, F.lit(2)).bitwiseOR(F.shiftleft(g["face"].cast("long"), 2 * MAX_LEVEL))
        return F.shiftleft(position, 1).bitwiseOR(F.lit(1))

    return let(F.struct(face.alias("face"), i.cast("long").alias("i"), j.cast("long").alias("j")), walk)


def from_direction(x: Column, y: Column, z: Column) -> Column:
    def on_face(d: Column) -> Column:
        u, v = project(d["face"], d["x"], d["y"], d["z"])
        return let(F.struct(d["face"].alias("face"), u.alias("u"), v.alias("v")), lambda p: from_grid(p["face"], _grid(p["u"]), _grid(p["v"])))

    seen = lambda d: let(F.struct(d["x"].alias("x"), d["y"].alias("y"), d["z"].alias("z"), face_of(d["x"], d["y"], d["z"]).alias("face")), on_face)
    return let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), seen)


def from_lat_lng(lat: Column, lng: Column) -> Column:
    """The leaf cell at a position in degrees."""
    return from_direction(*_normal(lat, lng))


def to_grid(cell: Column) -> Column:
    """``face, i, j, size``: a cell's lowest leaf and its width in leaves."""
    table = _table(TO_BITS)

    def walk(c: Column) -> Column:
        # Down to the step that holds the cell's level; what lies below it is cut off.
        def step(s: Column, k: Column) -> Column:
            at = F.call_function("shiftrightunsigned", c["id"], k).bitwiseAND(F.lit((1 << 2 * BITS) - 1)).cast("int")

            def turned(q: Column) -> Column:
                i, j = F.call_function("shiftright", q, F.lit(BITS + 2)), F.call_function("shiftright", q, F.lit(2)).bitwiseAND(F.lit((1 << BITS) - 1))
                down = lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.cast("long"))
                return F.struct(q.bitwiseAND(3).alias("o"), down(s["i"], i).alias("i"), down(s["j"], j).alias("j"))

            return let(F.element_at(table, F.shiftleft(s["o"], 2 * BITS) + at + 1), turned)

        start = F.struct(c["face"].bitwiseAND(1).cast("int").alias("o"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
        taken = F.slice(F.array(*map(F.lit, range(2 * (MAX_LEVEL - BITS) + 1, 0, -2 * BITS))), F.lit(1), F.ceil(c["level"] / BITS).cast("int"))
        walked = F.aggregate(taken, start, step)
        width = F.call_function("shiftleft", F.lit(1).cast("long"), (MAX_LEVEL - c["level"]).cast("int"))
        # The width of what the last step reached is at most the cell's.
        reached = F.call_function("shiftleft", F.lit(1).cast("long"), (MAX_LEVEL - BITS * F.ceil(c["level"] / BITS)).cast("int"))
        low = lambda a, r: (a * r["reached"]).bitwiseAND(-r["size"])
        return let(F.struct(walked.alias("w"), width.alias("size"), reached.alias("reached")), lambda r: F.struct(c["face"].alias("face"), low(r["w"]["i"], r).alias("i"), low(r["w"]["j"], r).alias("j"), r["size"].alias("size")))

    face = lambda c: F.call_function("shiftrightunsigned", c, F.lit(61)).cast("int")
    return let(cell, lambda c: let(F.struct(c.alias("id"), face(c).alias("face"), level(c).alias("level")), walk))


def bounds(cell: Column) -> Column:
    """``face, u0, u1, v0, v1``: the cell's rectangle on its face's plane."""
    edge = lambda a: st_to_uv(a.cast("double") / SIZE)
    return let(to_grid(cell), lambda g: F.struct(g["face"].alias("face"), edge(g["i"]).alias("u0"), edge(g["i"] + g["size"]).alias("u1"), edge(g["j"]).alias("v0"), edge(g["j"] + g["size"]).alias("v1")))


def to_lat_lng(x: Column, y: Column, z: Column) -> Column:
    return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lng"))


def _lat_lng(face: Column, u: Column, v: Column) -> Column:
    return let(F.struct(face.alias("f"), u.alias("u"), v.alias("v")), lambda p: to_lat_lng(*unproject(p["f"], p["u"], p["v"])))


def centre(cell: Column) -> Column:
    """``lat, lng`` of the cell's middle."""

    def middle(g: Column) -> Column:
        mid = lambda a: st_to_uv((a.cast("double") + g["size"].cast("double") / 2) / SIZE)
        return _lat_lng(g["face"], mid(g["i"]), mid(g["j"]))

    return let(to_grid(cell), middle)


def ring(cell: Column) -> Column:
    """The closed ring of the cell's corners, five ``[lng, lat]``."""

    def corners(b: Column) -> Column:
        corner = lambda u, v: let(_lat_lng(b["face"], b[u], b[v]), lambda at: F.array(at["lng"], at["lat"]))
        return F.array(corner("u0", "v0"), corner("u1", "v0"), corner("u1", "v1"), corner("u0", "v1"), corner("u0", "v0"))

    return let(bounds(cell), corners)


def neighbours(cell: Column) -> Column:
    """The cell and the eight around it at its level, distinct; steps over a face's edge go on to the next face."""
    steps = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])

    def around(c: Column) -> Column:
        g = c["grid"]

        def at(d: Column) -> Column:
            inside = (d["i"] >= 0) & (d["i"] < SIZE) & (d["j"] >= 0) & (d["j"] < SIZE)
            # Beyond the edge: a point just over it, halfway along the step, as seen from the sphere's centre.
            near = lambda a: F.greatest(F.lit(-1.0 - 1e-9), F.least(F.lit(1.0 + 1e-9), st_to_uv((a.cast("double") + g["size"].cast("double") / 2) / SIZE)))
            over = let(F.struct(near(d["i"]).alias("u"), near(d["j"]).alias("v")), lambda p: from_direction(*unproject(g["face"], p["u"], p["v"])))
            return let(F.when(inside, from_grid(g["face"], d["i"], d["j"])).otherwise(over), lambda leaf: parent(leaf, c["level"]))

        moved = F.transform(steps, lambda s: F.struct((g["i"] + g["size"] * s["i"]).alias("i"), (g["j"] + g["size"] * s["j"]).alias("j")))
        return F.array_distinct(F.transform(moved, at))

    return let(cell, lambda x: let(F.struct(to_grid(x).alias("grid"), level(x).alias("level")), around))


def point_blocking_cells(leaf: Column, at: int = 20) -> Column:
    """The point's cell at level ``at`` and its eight neighbours."""
    return neighbours(parent(leaf, at))


def is_point_cover(cells: Column) -> Column:
    return (F.size(cells) == 1) & (level(F.element_at(cells, 1)) == MAX_LEVEL)


# Covers as rows.


def drop_covered(df: DataFrame, owner: str = "owner", cell: str = "cell") -> DataFrame:
    """Distinct rows without those whose cell lies in a coarser cell of the same owner."""
    distinct = df.select(owner, cell).distinct()
    above = distinct.select(owner, F.col(cell).alias("_fine"), F.explode(F.filter(ancestors(F.col(cell)), lambda a: a != F.col(cell))).alias(cell))
    inside = above.join(distinct, [owner, cell], "left_semi").select(owner, F.col("_fine").alias(cell)).distinct()
    return distinct.join(inside, [owner, cell], "left_anti")


def merge(df: DataFrame, owner: str = "owner", cell: str = "cell") -> DataFrame:
    """Distinct cells of which none covers another of its owner, with four siblings as their parent.

    Rounds of one grouping by parent each: the four places below it are bits of
    a number, so neither lists nor joins are needed.  A round whose cells are as
    many as before has merged nothing.
    """
    up = parent(F.col(cell), level(F.col(cell)) - 1)
    place = F.expr("(`_at` - `_up`) div (`_at` & -`_at`) + 3").cast("int")
    whole = F.col("_places") == 15
    kids = F.array(*[F.when(F.col("_places").bitwiseAND(1 << k) != 0, kid) for k, kid in enumerate(_kids(F.col("_up")))])
    faces = level(F.col(cell)) == 0
    now = cut(df.select(owner, cell))
    size = now.count()
    while True:
        placed = now.filter(~faces).select(owner, F.col(cell).alias("_at"), up.alias("_up")).select(owner, "_up", F.call_function("shiftleft", F.lit(1), F.shiftright(place, 1)).alias("_place"))
        grouped = placed.groupBy(owner, "_up").agg(F.bit_or("_place").alias("_places"))
        below = grouped.select(owner, F.explode(F.when(whole, F.array("_up")).otherwise(F.array_compact(kids))).alias(cell))
        now = cut(below.unionByName(now.filter(faces).distinct()))
        before, size = size, now.count()
        if size == before:
            return now


def normalise(df: DataFrame, owner: str = "owner", cell: str = "cell") -> DataFrame:
    """The same areas with the fewest cells: no repeated or covered cells, four siblings as their parent."""
    return merge(drop_covered(df, owner, cell), owner, cell)
