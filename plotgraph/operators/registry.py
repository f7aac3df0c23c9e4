"""Looking plots up, and what a reader may see of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, geometry
from ..functions.lineage import cut

#: The levels a record keeps covers at.
LEVELS = (8, 13, 15, 18, 19, 20)
MASK_LEVEL = 10
ACRES_LIMIT, POINT_HECTARES_LIMIT = 1000.0, 4.0


def lookup(wanted: DataFrame, plots: DataFrame, ids: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """``wanted, geo_id, step``: the plot each wanted id names.

    First the full or short id of ``plots(geo_id, geo_id_short)``, then an
    older id of ``ids(alias, canonical)``, then a content hash of
    ``hashes(content_hash, geo_id)``.  The two fallbacks don't look at the
    relation, so the alias of a nested plot leads to its parent.  Ids that name
    nothing have a null ``geo_id`` and step ``not_found``.
    """
    w = wanted.select("wanted").distinct()
    names = plots.select(F.col("geo_id").alias("wanted"), "geo_id").unionByName(plots.select(F.col("geo_id_short").alias("wanted"), "geo_id"))
    steps = [names.withColumn("step", F.lit("id"))]
    if ids is not None:
        steps.append(ids.select(F.col("alias").alias("wanted"), F.col("canonical").alias("geo_id"), F.lit("alias").alias("step")))
    if hashes is not None:
        steps.append(hashes.select(F.col("content_hash").alias("wanted"), "geo_id", F.lit("hash").alias("step")))
    found = None
    for rank, s in enumerate(steps):
        s = s.join(w, "wanted", "left_semi").withColumn("rank", F.lit(rank))
        found = s if found is None else found.unionByName(s)
    first = found.groupBy("wanted").agg(F.min(F.struct("rank", "geo_id", "step")).alias("f"))
    return w.join(first, "wanted", "left").select("wanted", F.col("f.geo_id").alias("geo_id"), F.coalesce("f.step", F.lit("not_found")).alias("step"))


def translate(wanted: DataFrame, plots: DataFrame) -> DataFrame:
    """``wanted, other``: the short id of a full one and the full id of a short one; ids that name nothing have null."""
    both = plots.select(F.col("geo_id").alias("wanted"), F.col("geo_id_short").alias("other")).unionByName(plots.select(F.col("geo_id_short").alias("wanted"), F.col("geo_id").alias("other")))
    return wanted.select("wanted").distinct().join(both, "wanted", "left")


def kind_of(recorded: Column, cover: Column) -> Column:
    """``point`` or ``polygon``: as recorded, else a point if the cover is one leaf."""
    return F.when(recorded.isin("point", "polygon"), recorded).when(cells.is_point_cover(cover), "point").otherwise("polygon")


def published_area(kind: Column, declared: Column, approximate: Column) -> Column:
    """A point's declared area, else its approximate one; a polygon's approximate area; zero counts as none; four decimals."""
    some = lambda x: F.when(x != 0, x)
    return F.round(F.when(kind == "point", F.coalesce(some(declared), some(approximate))).otherwise(approximate), 4)


def usable_cover(v2_cover: Column, at_level: Column, s2_cells: Column) -> Column:
    """The first cover that isn't null or empty, else an empty one."""
    full = lambda x: F.when(F.size(x) > 0, x)
    return F.coalesce(full(v2_cover), full(at_level), full(s2_cells), F.array().cast("array<string>"))


def project_levels(levels: Column, requested: list[int]) -> Column:
    """A map without the levels that weren't asked for; keys that are no level stay; asking for none of the levels changes nothing.  The WKT goes either way."""
    wanted = set(LEVELS) & set(requested)
    dropped = [str(x) for x in LEVELS if x not in wanted] if wanted else []
    return F.map_filter(levels, lambda k, _: ~k.isin(*dropped, "wkt"))


def masked(plots: DataFrame) -> DataFrame:
    """What a reader without a grant sees of ``plots(geo_id, leaf, country, kind, area, mask_level)``: a coarse cell and its outline, never a coordinate."""
    cell = cells.parent(F.col("leaf"), MASK_LEVEL)
    return plots.select("geo_id", cells.id_to_token(cell).alias("cell"), cells.ring(cell).alias("outline"), "country", "kind", F.round("area", 1).alias("area"), F.coalesce("mask_level", F.lit("L0")).alias("masking_level"))


def disclosed(plots: DataFrame) -> DataFrame:
    """``geo_id, tier, wkt, lat, lng, cell``: with ``granted`` the exact position, else the coarse cell's middle."""
    cell = cells.parent(F.col("leaf"), MASK_LEVEL)
    middle = cells.centre(cell)
    wkt = F.concat(F.lit("POINT ("), F.format_string("%.5f", F.col("lng")), F.lit(" "), F.format_string("%.5f", F.col("lat")), F.lit(")"))
    seen = lambda exact, coarse: F.when(F.col("granted"), F.col(exact)).otherwise(middle[coarse])
    return plots.select("geo_id", F.when(F.col("granted"), "L1").otherwise("L0").alias("tier"), F.when(F.col("granted"), wkt).alias("wkt"), seen("lat", "lat").alias("lat"), seen("lng", "lng").alias("lng"), cells.id_to_token(cell).alias("cell"))


def full_view(plots: DataFrame, requested: list[int] | None = None, accounts: bool = False) -> DataFrame:
    """``geo_id, tier, geo_json, levels`` of ``plots(geo_id, wkt, levels, granted, account)``: the exact geometry for those who may see it.

    Tier ``L1`` needs a grant, or an account where the legacy switch
    ``accounts`` is on; all others are ``L0`` and get neither column.
    ``levels`` are the ``requested`` ones without the WKT; null if no known
    level is asked for.  Geometry is of the kind that the WKT names (points,
    lines, polygons and several polygons); what can't be parsed is null.
    """
    no = F.lit(False)
    may = F.coalesce("granted", no) | (F.coalesce("account", no) & F.lit(accounts))
    shape = geometry.from_wkt(F.col("wkt"))
    kind = geometry.wkt_kind(F.col("wkt"))
    as_json = lambda name, coordinates: F.when(kind == name.upper(), F.to_json(F.struct(F.lit(name).alias("type"), coordinates.alias("coordinates"))))
    exact = F.when(F.size(shape) > 0, F.coalesce(as_json("Point", shape[0][0][0]), as_json("LineString", shape[0][0]), as_json("Polygon", shape[0]), as_json("MultiPolygon", shape)))
    asked = bool(set(LEVELS) & set(requested or []))
    levels = F.when(may, project_levels(F.col("levels"), requested or [])) if asked else F.lit(None)
    return plots.select("geo_id", F.when(may, "L1").otherwise("L0").alias("tier"), F.when(may, exact).alias("geo_json"), levels.cast("map<string,string>").alias("levels"))


def flat_tokens(indices: Column) -> Column:
    """The distinct cell tokens of an index, JSON by level: only lists are taken, a bare text (such as the regime's name) isn't one."""
    values = F.map_values(F.from_json(indices, "map<string,string>"))
    lists = F.transform(F.filter(values, lambda v: v.startswith("[")), lambda v: F.from_json(v, "array<string>"))
    return F.array_distinct(F.flatten(F.filter(lists, lambda x: x.isNotNull())))


def at_coordinate(coordinates: DataFrame, plots: DataFrame, boundary_type: str | None = None) -> DataFrame:
    """``probe, geo_id``: plots ``(geo_id, cell)`` that list both the level-13 and the level-20 cell of ``coordinates(probe, lat, lng)``.

    With ``boundary_type`` only plots of that type (a column of theirs) count.
    """
    if boundary_type is not None:
        plots = plots.filter(F.col("boundary_type") == boundary_type)
    leaf = cells.from_lat_lng(F.col("lat"), F.col("lng"))
    keys = coordinates.select("probe", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), cells.parent(leaf, n).alias("cell")) for n in (13, 20)])).alias("k")).select("probe", "k.*")
    hits = keys.join(plots.select("geo_id", "cell").distinct(), "cell")
    return hits.groupBy("probe", "geo_id").agg(F.countDistinct("level").alias("n")).filter("n = 2").select("probe", "geo_id")


#: Side of the tile that holds all coordinates, in degrees; edges with which a tile isn't split any more; and the tiles' finest level (an eighth of a degree).
WORLD, FEW_EDGES, FINEST = 512.0, 16, 12
#: Where in a tile its anchor is, in parts of its side: no place where borders like to run.
ANCHOR = (0.4871, 0.5139)

EDGES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def _flips(edges: Column, x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    """Whether an odd number of edges lies between two points, going level to the other's longitude and then straight to it.

    An edge is passed as in ``geometry.contains``: what lies on it counts as
    east and north of it.
    """

    def passed(along: Column, across: Column, to: Column, a: tuple[str, str], b: tuple[str, str]) -> Column:
        def hit(e: Column) -> Column:
            at = e[a[0]] + (e[a[1]] - e[a[0]]) * ((across - e[b[0]]) / (e[b[1]] - e[b[0]]))
            return ((e[b[0]] > across) != (e[b[1]] > across)) & (at > F.least(along, to)) & (at <= F.greatest(along, to))

        return F.size(F.filter(edges, hit))

    level = passed(x, y, to_x, ("x0", "x1"), ("y0", "y1"))
    straight = passed(y, to_x, to_y, ("y0", "y1"), ("x0", "x1"))
    return (level + straight) % 2 == 1


def country_index(countries: DataFrame, few: int = FEW_EDGES, finest: int = FINEST) -> DataFrame:
    """``position, country, level, tx, ty, inside, edges``: tiles over ``countries(position, country, shape)``.

    All countries are split together, level by level.  A tile carries only the
    edges that touch it and whether its anchor is inside.  One without edges is
    done (kept if it is inside), one with up to ``few`` edges, or of the finest
    level, is kept with them.
    """
    point = lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))
    rings = F.filter(F.transform(F.flatten("shape"), lambda r: F.transform(r, point)), lambda r: F.size(r) > 1)
    leg = lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))
    edges = F.flatten(F.transform(rings, lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1)), leg)))
    low = F.lit(-WORLD / 2)
    # East of the world nothing is inside; from there the anchor of level 0 is found.
    rows = countries.filter(F.size("shape") > 0).select("position", "country", F.lit(0).alias("level"), F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"), edges.cast(EDGES).alias("edges"))
    anchor = lambda t, side, k: low + (t + ANCHOR[k]) * side
    start = _flips(F.col("edges"), anchor(F.lit(0), F.lit(WORLD), 0), anchor(F.lit(0), F.lit(WORLD), 1), F.lit(WORLD), anchor(F.lit(0), F.lit(WORLD), 1))
    rows = rows.withColumn("inside", start)
    done: list[DataFrame] = []
    for at in range(finest + 1):
        side = WORLD / 2**at
        west, south = low + F.col("tx") * side, low + F.col("ty") * side
        # Edges whose box meets the tile, and that don't leave all its corners on one side.
        span = lambda e, a, b, lo: (F.least(e[a], e[b]) <= lo + side) & (F.greatest(e[a], e[b]) >= lo)  # noqa: B023, E731

        def apart(e: Column) -> Column:
            sides = [F.signum((e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"])) for x in (west, west + side) for y in (south, south + side)]  # noqa: B023
            return F.abs(sides[0] + sides[1] + sides[2] + sides[3]) == 4

        near = F.filter("edges", lambda e: span(e, "x0", "x1", west) & span(e, "y0", "y1", south) & ~apart(e))  # noqa: B023
        state = cut(rows.withColumn("edges", near).filter((F.size("edges") > 0) | F.col("inside")))
        last = F.lit(at == finest) | (F.size("edges") <= few)
        done.append(state.filter(last))
        state = state.filter(~last)
        if at == finest or state.isEmpty():
            break
        quarters = F.array(*[F.struct((F.col("tx") * 2 + i).alias("tx"), (F.col("ty") * 2 + j).alias("ty")) for i in (0, 1) for j in (0, 1)])
        below = state.select("position", "country", (F.col("level") + 1).alias("level"), "edges", F.col("inside").alias("above"), *[anchor(F.col(t), F.lit(side), k).alias(f"a{t}") for k, t in enumerate(("tx", "ty"))], F.explode(quarters).alias("q"))
        mine = [anchor(F.col(f"q.{t}"), F.lit(side / 2), k) for k, t in enumerate(("tx", "ty"))]
        rows = below.select("position", "country", "level", F.col("q.tx").alias("tx"), F.col("q.ty").alias("ty"), "edges", (F.col("above") != _flips(F.col("edges"), *mine, F.col("atx"), F.col("aty"))).alias("inside"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("position", "country", "level", "tx", "ty", "inside", "edges")


def country_of(points: DataFrame, countries: DataFrame, few: int = FEW_EDGES, finest: int = FINEST) -> DataFrame:
    """``geo_id, country``: the first country (by ``position``) whose polygon holds the point, '' if none does.

    ``points(geo_id, lng, lat)``, ``countries(position, country, shape)``.  A
    point meets the tiles of ``country_index`` by equality: one that lies
    inside answers by itself, one on a border with the few edges that it has.
    No row carries a whole shape, and a large country is as many keys as tiles.
    Points without coordinates are in no country.
    """
    index = cut(country_index(countries, few, finest))
    levels = sorted(r["level"] for r in index.select("level").distinct().collect())  # 13 at most
    low = -WORLD / 2
    tile = lambda n: F.struct(F.lit(n).alias("level"), F.floor((F.col("lng") - low) / (WORLD / 2**n)).alias("tx"), F.floor((F.col("lat") - low) / (WORLD / 2**n)).alias("ty"))
    if not levels:
        return points.select("geo_id", F.lit("").alias("country"))
    keys = points.filter("lng is not null and lat is not null").select("geo_id", "lng", "lat", F.explode(F.array(*map(tile, levels))).alias("k")).select("geo_id", "lng", "lat", "k.*")
    side = F.lit(WORLD) / F.pow(F.lit(2.0), F.col("level"))
    anchor = [low + (F.col(t) + ANCHOR[k]) * side for k, t in enumerate(("tx", "ty"))]
    hit = keys.join(index, ["level", "tx", "ty"]).filter(F.col("inside") != _flips(F.col("edges"), F.col("lng"), F.col("lat"), *anchor))
    first = hit.groupBy("geo_id").agg(F.min(F.struct("position", "country")).alias("f"))
    return points.select("geo_id").join(first, "geo_id", "left").select("geo_id", F.coalesce("f.country", F.lit("")).alias("country"))


def back_fill_country(plots: DataFrame, countries: DataFrame) -> DataFrame:
    """``plots(geo_id, country, lng, lat)`` with missing countries (null or '') filled from their first vertex."""
    missing = plots.filter(F.coalesce("country", F.lit("")) == "")
    found = country_of(missing.select("geo_id", "lng", "lat"), countries).withColumnRenamed("country", "found")
    out = plots.join(found, "geo_id", "left")
    return out.select("geo_id", F.when(F.coalesce("country", F.lit("")) == "", F.coalesce("found", F.lit(""))).otherwise(F.col("country")).alias("country"))


def export_geojson(plots: DataFrame) -> DataFrame:
    """``geo_id, status, feature``: the regulatory feature of each plot ``(geo_id, kind, shape, area, country, granted)``.

    Polygons become MultiPolygons.  A point needs a declared area of 4 ha or
    less, given with four decimals.  Refusals: 401 without a grant, 500
    without a geometry, 422 for a point without a usable area.
    """
    bad_point = (F.col("kind") == "point") & (F.col("area").isNull() | (F.col("area") <= 0) | (F.col("area") > POINT_HECTARES_LIMIT))
    status = F.when(~F.coalesce("granted", F.lit(False)), 401).when(F.col("shape").isNull(), 500).when(bad_point, 422).otherwise(200)
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.col("shape")[0][0][0].alias("coordinates")).alias("geometry"), F.struct(F.round("area", 4).alias("Area"), F.col("country").alias("ProducerCountry")).alias("properties")))
    polygon = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), geometry.canonical(F.col("shape")).alias("coordinates")).alias("geometry"), F.struct(F.col("country").alias("ProducerCountry")).alias("properties")))
    return plots.withColumn("status", status).select("geo_id", "status", F.when(F.col("status") == 200, F.when(F.col("kind") == "point", point).otherwise(polygon)).alias("feature"))


def registration_outcomes(rows: DataFrame, known_hashes: DataFrame, resolved: DataFrame) -> DataFrame:
    """``row, outcome`` of a bulk upload ``rows(row, content_hash, kind, declared, acres, unusable)``.

    In order: ``exists`` by content hash (registered, or an earlier row of this
    upload), ``skipped`` for a declared area out of bounds, an unusable
    geometry or too many acres, ``exists`` by resolution ``resolved(row)``,
    else ``created``.
    """
    known = known_hashes.select("content_hash").distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("row")) > 1
    r = rows.withColumn("again", first & F.col("content_hash").isNotNull()).join(known, "content_hash", "left").join(resolved.select("row").distinct().withColumn("resolved", F.lit(True)), "row", "left")
    area = (F.col("kind") == "point") & ((F.coalesce("declared", F.lit(0.0)) < 0) | (F.coalesce("declared", F.lit(0.0)) > POINT_HECTARES_LIMIT))
    skipped = area | F.col("unusable").isNotNull() | (F.coalesce("acres", F.lit(0.0)) > ACRES_LIMIT)
    return r.select("row", F.when(F.col("known") | F.col("again"), "exists").when(skipped, "skipped").when(F.col("resolved"), "exists").otherwise("created").alias("outcome"))
