"""Deciding whether a plot is new, the same as another, or nested in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.lineage import cut
from .overlap import cover_overlap

EARTH_METRES = 6_371_010.0


def metres_between(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere."""
    half = lambda x, y: F.sin((F.radians(y) - F.radians(x)) / 2)
    h = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half(lng1, lng2), 2)
    return 2 * EARTH_METRES * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def candidates(probes: DataFrame, registered: DataFrame, level: int = 13) -> DataFrame:
    """``a, b``: probes and registered plots that share a blocking cell, both ``(owner, cell)``."""
    key = F.when(cells.level(F.col("cell")) > level, cells.parent(F.col("cell"), level)).otherwise(F.col("cell")).alias("key")
    left = probes.select(F.col("owner").alias("a"), key).distinct()
    right = registered.select(F.col("owner").alias("b"), key).distinct()
    return left.join(right.hint("merge"), "key").filter("a <> b").select("a", "b").distinct()


def score(probes: DataFrame, registered: DataFrame, pairs: DataFrame) -> DataFrame:
    """``cover_overlap`` of the pairs, probes against registered plots."""
    covers = probes.select("owner", "cell").unionByName(registered.select("owner", "cell")).distinct()
    return cover_overlap(pairs, covers)


def verdicts(scored: DataFrame, threshold: float = 95.0) -> DataFrame:
    """The candidates that pass: ``a, b, relation, score``; the same plot if IoU reaches the threshold (percent), else nested if containment does.

    Direction is not looked at: a large plot that comes after a small one is nested in it too.
    """
    relation = F.when(F.col("iou") * 100.0 >= threshold, "same_as").when(F.col("containment") * 100.0 >= threshold, "child_of")
    out = scored.withColumn("relation", relation).filter("relation is not null")
    return out.select("a", "b", "relation", F.when(F.col("relation") == "same_as", F.col("iou")).otherwise(F.col("containment")).alias("score"))


def best(passed: DataFrame) -> DataFrame:
    """One verdict per probe: the same plot before a nested one, then the highest score, then the smallest id."""
    order = Window.partitionBy("a").orderBy((F.col("relation") != "same_as").cast("int"), F.col("score").desc(), "b")
    return passed.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def earliest(passed: DataFrame, created: DataFrame) -> DataFrame:
    """One verdict per probe: the same plot before a nested one, then the earliest of ``created(b, created_at)``, then the smallest id."""
    order = Window.partitionBy("a").orderBy((F.col("relation") != "same_as").cast("int"), "created_at", "b")
    return passed.join(created, "b").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def near_points(probes: DataFrame, registered: DataFrame, metres: float = 10.0) -> DataFrame:
    """``a, b, metres``: registered points within ``metres`` of a probe, both ``(geo_id, lat, lng)``.

    A probe looks into its level-20 cell and the eight around it.  Registered
    points are never broadcast: they may be many in a small compressed file.
    """
    keys = F.explode(cells.point_blocking_cells(cells.from_lat_lng(F.col("lat"), F.col("lng")))).alias("key")
    left = probes.select(F.col("geo_id").alias("a"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), keys)
    right = registered.select(F.col("geo_id").alias("b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), cells.parent(cells.from_lat_lng(F.col("lat"), F.col("lng")), 20).alias("key"))
    away = metres_between(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    return left.join(right.hint("merge"), "key").withColumn("metres", away).filter(F.col("metres") <= metres).select("a", "b", "metres").distinct()


def points_in_covers(points: DataFrame, covers: DataFrame) -> DataFrame:
    """``geo_id, owner``: covers that hold the point ``points(geo_id, leaf)``."""
    up = points.select("geo_id", F.explode(cells.ancestors(F.col("leaf"))).alias("cell"))
    return up.join(covers.select("owner", "cell"), "cell").select("geo_id", "owner").distinct()


def resolve_batch(plots: DataFrame, links: DataFrame) -> DataFrame:
    """Decisions of registering plots one after the other, in rounds.

    ``plots(id, at)`` gives the order; ``links(a, b, relation, score)`` are
    verdicts of either direction.  A plot is an alias if a ``same_as``
    neighbour before it is canonical; it is canonical if none can become so.
    Each round decides every plot whose earlier neighbours are decided, so the
    rounds are bounded by the longest chain of neighbours, not by the plots.
    An alias goes to its canonical neighbour of highest score (ties: smallest
    ``name``, a column of ``plots`` that may be there, then id).  A canonical
    plot may be nested in an earlier canonical one.  Plots whose column
    ``registered`` is true were decided before: they are canonical, stay as
    they are, and are not among the rows.

    Returns ``id, outcome, target, score``.
    """
    name = F.col("name") if "name" in plots.columns else F.lit(None).cast("string")
    before = F.coalesce("registered", F.lit(False)) if "registered" in plots.columns else F.lit(False)
    every = plots.select("id", "at", name.alias("name"), before.alias("registered"))
    order = every.filter("not registered").select("id", "at")
    both = links.select("a", "b", "relation", "score").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation", "score")).distinct()
    placed = both.join(order.select(F.col("id").alias("a"), F.col("at").alias("at_a")).hint("merge"), "a").join(every.select(F.col("id").alias("b"), F.col("at").alias("at_b"), "name", "registered").hint("merge"), "b")
    earlier = cut(placed.filter("registered or at_b < at_a or (at_b = at_a and b < a)").select("a", "b", "relation", "score", "name", "registered"))
    same = earlier.filter("relation = 'same_as'").select("a", "b")
    state = cut(order.select("id").join(same.select(F.col("a").alias("id")).distinct().hint("merge"), "id", "left_semi").withColumn("canonical", F.lit(None).cast("boolean")))
    free = order.select("id").join(same.select(F.col("a").alias("id")).distinct().hint("merge"), "id", "left_anti").withColumn("canonical", F.lit(True))
    held = earlier.filter("registered").select(F.col("b").alias("id"), F.lit(True).alias("canonical")).distinct()
    state = cut(free.unionByName(state).unionByName(held))
    while not state.filter("canonical is null").isEmpty():
        seen = same.join(state.select(F.col("id").alias("b"), "canonical").hint("merge"), "b").groupBy("a").agg(F.max(F.coalesce("canonical", F.lit(False))).alias("hit"), F.count(F.when(F.col("canonical").isNull(), 1)).alias("open"))
        now = state.join(seen.withColumnRenamed("a", "id").hint("merge"), "id", "left")
        decided = F.coalesce("canonical", F.when(F.col("hit"), F.lit(False)).when(F.col("open") == 0, F.lit(True)))
        state = cut(now.select("id", decided.alias("canonical")))
    mine = earlier.join(state.select(F.col("id").alias("a"), F.col("canonical").alias("mine")).hint("merge"), "a").join(state.filter("canonical").select(F.col("id").alias("b")).hint("merge"), "b")
    fits = mine.filter("relation = if(mine, 'child_of', 'same_as')")
    top = best(fits.select("a", F.struct("name", "b").alias("b"), "relation", "score"))
    out = state.join(order.select("id").hint("merge"), "id").join(top.withColumnRenamed("a", "id").hint("merge"), "id", "left")
    return out.select("id", F.coalesce("relation", F.lit("new")).alias("outcome"), F.col("b.b").alias("target"), "score")
