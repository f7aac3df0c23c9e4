"""Recall questions over lots: what fed a lot, and which lots contain a plot.

Every traversal answers many seeds at once: a driver loop with one equi-join
per level, an anti-join against what was seen, and a checkpoint that cuts the
lineage.  Cycles end because no node is visited twice for a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.lineage import cut

MAX_DEPTH = 64
#: Parts in which the lots of a set of regions meet the seeds under it.
PARTS = 16
#: Regions of a lot that are listed with it.
BUSY = 64
#: Members are narrowed to the nodes first if these are fewer by this factor; at most so many nodes are sent to every task.
FEW, SENT = 100, 50_000
#: Members whose lots, with all above them, one task puts together.
LINES = 100_000


def equivalence_set(seeds: DataFrame, aliases: DataFrame) -> DataFrame:
    """``seed, node``: the seed and the ids that one ``same_as`` alias step leads to, in either direction.

    ``seeds(seed)``; ``aliases(alias, canonical, relation)``.  ``child_of`` is no identity, and a second step isn't taken.
    """
    same = aliases.filter("relation = 'same_as'")
    forward = seeds.join(same, F.col("seed") == F.col("alias")).select("seed", F.col("canonical").alias("node"))
    backward = seeds.join(same, F.col("seed") == F.col("canonical")).select("seed", F.col("alias").alias("node"))
    return seeds.select("seed", F.col("seed").alias("node")).unionByName(forward).unionByName(backward).distinct()


def reverse_lookup(seeds: DataFrame, members: DataFrame, aliases: DataFrame) -> DataFrame:
    """``seed, list_id``: lists that hold the seed or an equivalent of it, one hop."""
    return equivalence_set(seeds, aliases).join(members, F.col("node") == F.col("geoid")).select("seed", "list_id").distinct()


def walk(start: DataFrame, edges: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``seed, node, depth`` of all nodes reached from ``start(seed, node)`` over ``edges(source, target)``, shallowest depth; and the frontier left at ``depth``.

    With ``depth`` levels at most are visited.
    """
    frontier = cut(start.select("seed", "node").distinct())
    seen, at = None, 0
    links = edges.select("source", "target").distinct()
    while (depth is None or at < depth) and not frontier.isEmpty():
        level = frontier.withColumn("depth", F.lit(at))
        seen = level if seen is None else seen.unionByName(level)
        reached = frontier.join(links, F.col("node") == F.col("source")).select("seed", F.col("target").alias("node")).distinct()
        frontier = cut(reached.join(seen, ["seed", "node"], "left_anti"))
        at += 1
    return (frontier.withColumn("depth", F.lit(0)).limit(0) if seen is None else seen), frontier


def ancestor_probe(covers: DataFrame, region_cells: DataFrame) -> DataFrame:
    """``owner, region_id``: regions with a cell that is one of the owner's cells or an ancestor of it.

    The ancestors at all levels that regions have are listed, so a containment
    join is an equi-join.  A region cell finer than the plot's own isn't matched.
    """
    levels = [r[0] for r in region_cells.select(cells.level(F.col("cell")).alias("level")).distinct().collect()]  # 31 at most
    own = cells.level(F.col("cell"))
    up = F.filter(F.array(*[F.when(own >= n, cells.parent(F.col("cell"), n)) for n in levels]), lambda c: c.isNotNull())
    probes = covers.select("owner", F.explode(up if levels else F.array().cast("array<long>")).alias("cell"))
    return probes.join(region_cells.select("region_id", "cell"), "cell").select("owner", "region_id").distinct()


def between(up: DataFrame) -> DataFrame:
    """The edges of ``up(source, target)`` from lots that hold others."""
    holds = up.select(F.col("target").alias("source")).distinct()
    return cut(up.join(holds.hint("merge"), "source", "left_semi"))


def climb(nodes: DataFrame, members: DataFrame, up: DataFrame, inner: DataFrame, alone: bool = False) -> DataFrame:
    """``seed, node, depth``: the lots that list a node of ``nodes(seed, node)`` (depth 0) and all above them over ``up(source, target)``, at their least depth.

    What is above a lot is walked once for each lot that holds others, and
    goes with the lot to the plots in it, as lists: nothing in between has a
    row for each seed and lot.  A plot's lots are put together before its
    seeds get them.  ``inner``: ``between(up)``.  ``alone``: every node is its own and only seed.
    Rows of ``members(list_id, geoid)`` may repeat.
    """
    inside = members.select(F.col("list_id").alias("lot"), "geoid").filter("geoid is not null")
    edges = up.select("source", "target").filter("source is not null")
    first, n, lines = edges, nodes.count(), members.count()
    if n * FEW <= lines:
        ids = nodes.select("node").distinct()
        # A checked bound: few ids are sent to the rows, more meet them by sorting.
        inside = cut(inside.join(F.broadcast(ids) if n <= SENT else ids.hint("merge"), F.col("geoid") == F.col("node"), "left_semi"))
        lines = inside.count()
        first = edges.join(inside.select(F.col("lot").alias("source")).distinct().hint("merge"), "source", "left_semi")
    tasks = max(1, -(-lines // LINES))
    above, _ = walk(first.select(F.col("target").alias("seed"), F.col("target").alias("node")), inner)
    above = above.repartition("seed").sortWithinPartitions("seed", "depth").withColumn("chunk", _chunk())
    above = above.groupBy("seed", "chunk").agg(F.collect_list(F.struct("node", "depth")).alias("list"))
    above = above.select(F.col("seed").alias("target"), F.col("list.node").alias("nodes"), F.transform("list.depth", lambda d: d + 1).alias("depths"))
    over = first.join(above.hint("merge"), "target").select(F.col("source").alias("lot"), "nodes", "depths")
    held = inside.join(over.hint("merge"), "lot", "left").select("geoid", "lot", "nodes", "depths").repartition(tasks, "geoid")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    lots = F.arrays_zip(F.concat(F.array("lot"), none("nodes", "array<string>")).alias("node"), F.concat(F.array(F.lit(0)), none("depths", "array<int>")).alias("depth"))
    each = held.select("geoid", F.explode(lots).alias("at")).select("geoid", "at.node", "at.depth").groupBy("geoid", "node").agg(F.min("depth").alias("depth"))
    if alone:
        return each.join(nodes.select(F.col("seed").alias("geoid")).distinct().hint("merge"), "geoid", "left_semi").select(F.col("geoid").alias("seed"), "node", "depth")
    lists = each.sortWithinPartitions("geoid", "depth", "node").withColumn("chunk", _chunk()).groupBy("geoid", "depth", "chunk").agg(F.collect_list("node").alias("nodes"))
    sent = lists.join(nodes.select("seed", F.col("node").alias("geoid")).distinct().hint("merge"), "geoid").select("seed", "depth", "nodes").repartition(tasks, "seed")
    return sent.select("seed", "depth", F.explode("nodes").alias("node")).groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def _chunk(rows_log2: int = 10) -> Column:
    """The number of a run of 1,024 rows of a task: groups of a key and a run are short lists, however many rows the key has."""
    return F.shiftright(F.monotonically_increasing_id(), rows_log2)


class TraceForward:
    """All lots that contain a seed plot, see ``trace_forward``.

    A region may be in many lots and over many seeds, so the lots above it are
    walked once a region (``above(region_id, node, depth)``) and meet the seeds
    only where rows are returned: a lot that several regions of a seed reach is
    given by the one that is nearest, which ``near``, the lot's own list of
    regions, shows without a grouping.  Lots that more than ``BUSY`` regions
    reach have no such list and are grouped by sets of regions (``key``).
    ``keyed(seed, key, regions)`` are the seeds under regions, ``free(seed,
    node, direct, depth)`` what the others reach, ``held(seed, node, direct,
    depth, other)`` what they reach by themselves; ``other`` is the depth at
    which their regions reach the same lot.
    """

    def __init__(self, seeds: DataFrame, members: DataFrame, list_parents: DataFrame, aliases: DataFrame | None = None, covers: DataFrame | None = None, region_cells: DataFrame | None = None, region_parents: DataFrame | None = None):
        up = list_parents.select(F.col("child").alias("source"), F.col("parent").alias("target"))
        inner, alone = between(up), aliases is None
        nodes = seeds.select("seed", F.col("seed").alias("node")) if alone else cut(equivalence_set(seeds, aliases))
        reach = lambda n: climb(n, members, up, inner, alone).select("seed", "node", (F.col("depth") == 0).alias("direct"), "depth")
        self.keyed = None
        if covers is None:
            self.free = reach(nodes)
            return
        mine = nodes.join(covers, F.col("node") == F.col("owner")).select(F.col("seed").alias("owner"), "cell")
        over = ancestor_probe(mine, region_cells).join(region_parents.select("region_id").distinct(), "region_id", "left_semi")
        under = over.groupBy(F.col("owner").alias("seed")).agg(F.array_sort(F.collect_set("region_id")).alias("regions"))
        self.keyed = cut(under.select("seed", "regions", F.sha2(F.to_json("regions"), 256).alias("key")))
        of = region_parents.select("list_id", F.col("region_id").alias("geoid"))
        self.above = cut(climb(of.select(F.col("geoid").alias("seed"), F.col("geoid").alias("node")).distinct(), of, up, inner, True).withColumnRenamed("seed", "region_id"))
        self.free = reach(nodes.join(self.keyed.select("seed").hint("merge"), "seed", "left_anti"))
        mine = reach(nodes.join(self.keyed.select("seed").hint("merge"), "seed", "left_semi"))
        mine = mine.join(self._near.hint("merge"), "node", "left").join(self.keyed.hint("merge"), "seed")
        mine = mine.join(self._busy.select("key", "node", F.col("depth").alias("busy")).hint("merge"), ["key", "node"], "left")
        other = F.coalesce("busy", F.get(_reaching(), F.lit(0))["depth"])
        self.held = mine.select("seed", "node", "direct", "depth", other.alias("other"))

    @property
    def _near(self) -> DataFrame:
        """``node, near``: lots of few regions with these, the nearest first."""
        few = self.above.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") <= BUSY).select("node")
        return self.above.join(few.hint("merge"), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("depth", "region_id"))).alias("near"))

    @property
    def _keys(self) -> DataFrame:
        return self.keyed.dropDuplicates(["key"]).select("key", "regions")

    @property
    def _busy(self) -> DataFrame:
        """``key, node, depth``: lots of many regions, for each set of regions."""
        many = self.above.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > BUSY).select("node")
        rows = self.above.join(many.hint("merge"), "node", "left_semi")
        return self._keys.select("key", F.explode("regions").alias("region_id")).join(rows.hint("merge"), "region_id").groupBy("key", "node").agg(F.min("depth").alias("depth"))

    def _light(self, left: DataFrame, on: list[str]) -> DataFrame:
        """``left(regions, region_id, ...)`` with the lots of few regions, each by the nearest of ``regions`` only."""
        rows = self._near.select("node", F.explode("near").alias("at"), "near").select("node", "at.depth", "at.region_id", "near", _part(F.col("node")).alias("part"))
        once = (F.size("near") == 1) | (F.get(_reaching(), F.lit(0))["region_id"] == F.col("region_id"))
        return left.join(rows.select("node", "depth", "region_id", "near", *[c for c in on if c == "part"]).hint("merge"), on).filter(once)

    @property
    def sets(self) -> DataFrame:
        """``key, node, depth``: what a set of regions reaches."""
        each = self._keys.select("key", "regions", F.explode("regions").alias("region_id"))
        return self._light(each, ["region_id"]).select("key", "node", "depth").unionByName(self._busy)

    @property
    def lots(self) -> DataFrame:
        """``seed, list_id, resolution, depth``: seeds meet the lots of their regions part by part and in groups of one set, so what is sent grows with seeds and lots, not with their product."""
        label = F.when(F.col("direct"), "match").otherwise("contained").alias("resolution")
        own = self.free.select("seed", F.col("node").alias("list_id"), label, "depth")
        if self.keyed is None:
            return own
        own = own.unionByName(self.held.select("seed", F.col("node").alias("list_id"), label, F.least("depth", "other").alias("depth")))
        # A seed's own lots are left out part by part; lists of a part are short.
        taken = self.held.filter("other is not null").groupBy("seed", _part(F.col("node")).alias("part")).agg(F.collect_list("node").alias("taken"))
        parts = self.keyed.select("seed", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
        parts = parts.join(taken.hint("merge"), ["seed", "part"], "left").repartition("key", "part").sortWithinPartitions("key", "part").withColumn("chunk", _chunk(8))
        groups = parts.groupBy("key", "part", "chunk").agg(F.collect_list(F.struct("seed", "taken")).alias("seeds")).join(self._keys.hint("merge"), "key")
        light = self._light(groups.select("part", "regions", F.explode("regions").alias("region_id"), "seeds"), ["region_id", "part"]).select("node", "depth", "seeds")
        busy = groups.select("key", "part", "seeds").join(self._busy.withColumn("part", _part(F.col("node"))).hint("merge"), ["key", "part"]).select("node", "depth", "seeds")
        rest = light.unionByName(busy).select("node", "depth", F.explode("seeds").alias("s")).filter(F.col("s.taken").isNull() | ~F.array_contains("s.taken", F.col("node")))
        return own.unionByName(rest.select("s.seed", F.col("node").alias("list_id"), F.lit("contained").alias("resolution"), "depth"))

    @property
    def labels(self) -> DataFrame:
        """``seed, resolution, lots``: how many of each resolution, without the lots themselves."""
        counts = self.free.select("seed", F.col("direct").cast("long").alias("match"), (~F.col("direct")).cast("long").alias("rest"))
        if self.keyed is not None:
            # What both reach counts once, as the seed's own.
            counts = counts.unionByName(self.held.select("seed", F.col("direct").cast("long").alias("match"), ((~F.col("direct")).cast("long") - F.col("other").isNotNull().cast("long")).alias("rest")))
            sizes = self.keyed.select("seed", "key").join(self.sets.groupBy("key").agg(F.count("*").alias("rest")).hint("merge"), "key")
            counts = counts.unionByName(sizes.select("seed", F.lit(0).cast("long").alias("match"), "rest"))
        counts = counts.groupBy("seed").agg(F.sum("match").alias("match"), F.sum("rest").alias("contained"))
        return counts.select("seed", F.explode(F.create_map(F.lit("match"), "match", F.lit("contained"), "contained")).alias("resolution", "lots")).filter("lots > 0")


def _part(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(PARTS))


def _reaching() -> Column:
    """Of a lot's regions, ``near``, those among ``regions``."""
    return F.filter("near", lambda x: F.array_contains("regions", x["region_id"]))


def trace_forward(seeds: DataFrame, members: DataFrame, list_parents: DataFrame, aliases: DataFrame | None = None, covers: DataFrame | None = None, region_cells: DataFrame | None = None, region_parents: DataFrame | None = None) -> DataFrame:
    """``seed, list_id, resolution, depth``: all lots that contain a seed plot.

    ``match``: the lot lists the seed or an equivalent.  ``contained``: it
    holds a region over the seed's cells, or it is above such a lot.  An
    unknown seed gives no rows.

    ``members(list_id, geoid)``, ``list_parents(child, parent)``,
    ``covers(owner, cell)``, ``region_cells(region_id, cell)``,
    ``region_parents(region_id, list_id)``.
    """
    return TraceForward(seeds, members, list_parents, aliases, covers, region_cells, region_parents).lots


class TraceBack:
    """What fed the root lots: ``hops``, ``edges``, ``closure`` and ``summary`` as DataFrames.

    ``roots(root)``; tables as in ``trace_forward``, with ``artifacts(list_id,
    location, event_type)``.  One hop per lot, at its shallowest depth, at most
    ``depth`` levels (1 to 64).  Regions are reported, not expanded.
    """

    def __init__(self, roots: DataFrame, members: DataFrame, list_parents: DataFrame, artifacts: DataFrame, region_parents: DataFrame | None = None, depth: int = MAX_DEPTH):
        down = list_parents.select(F.col("parent").alias("source"), F.col("child").alias("target"))
        visited, rest = walk(roots.select(F.col("root").alias("seed"), F.col("root").alias("node")), down, max(1, min(MAX_DEPTH, depth)))
        self.visited = cut(visited.select(F.col("seed").alias("root"), F.col("node").alias("list_id"), "depth"))
        self.rest = rest.select(F.col("seed").alias("root")).distinct()
        kinds = [members.select("list_id", F.col("geoid").alias("child"), F.lit("geoid").alias("kind")), list_parents.select(F.col("parent").alias("list_id"), "child", F.lit("list").alias("kind"))]
        if region_parents is not None:
            kinds.append(region_parents.select("list_id", F.col("region_id").alias("child"), F.lit("region").alias("kind")))
        below = kinds[0]
        for k in kinds[1:]:
            below = below.unionByName(k)
        self.edges = self.visited.select("root", "list_id").join(below.distinct(), "list_id").select("root", "list_id", "child", "kind")
        per = self.edges.groupBy("root", "list_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("child")))).alias(c) for k, c in (("geoid", "geoids"), ("list", "input_list_ids"), ("region", "input_region_ids"))])
        none = F.array().cast("array<string>")
        hops = self.visited.join(per, ["root", "list_id"], "left").join(artifacts.select("list_id", "location", "event_type"), "list_id", "left")
        self.hops = hops.select("root", "list_id", "depth", "event_type", "location", F.col("location").isNotNull().alias("location_recorded"), *[F.coalesce(c, none).alias(c) for c in ("geoids", "input_list_ids", "input_region_ids")])

    @property
    def closure(self) -> DataFrame:
        """``root, geoid``: every plot that fed a root."""
        return self.edges.filter("kind = 'geoid'").select("root", F.col("child").alias("geoid")).distinct()

    @property
    def missing_locations(self) -> DataFrame:
        return self.hops.filter("not location_recorded").select("root", "list_id", "depth")

    @property
    def summary(self) -> DataFrame:
        """A row per root: hops, their greatest depth, recorded locations, regions, and whether lots are left beyond the depth."""
        each = self.hops.groupBy("root").agg(F.count("*").alias("hops"), F.max("depth").alias("max_depth"), F.count("location").alias("locations"), F.max(F.size("input_region_ids") > 0).alias("regions_unexpanded"))
        return each.join(self.rest.withColumn("truncated", F.lit(True)), "root", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def list_members(members: DataFrame, list_parents: DataFrame, region_parents: DataFrame) -> DataFrame:
    """``list_id, member``: plots as they are, lists behind ``L:``, regions behind ``R:``."""
    lists = list_parents.select(F.col("parent").alias("list_id"), F.concat(F.lit("L:"), "child").alias("member"))
    regions = region_parents.select("list_id", F.concat(F.lit("R:"), "region_id").alias("member"))
    return members.select("list_id", F.col("geoid").alias("member")).unionByName(lists).unionByName(regions).distinct()


def split_members(rows: DataFrame) -> DataFrame:
    """``list_id, kind, id`` from ``list_id, member``."""
    m = F.col("member")
    kind = F.when(m.startswith("L:"), "list").when(m.startswith("R:"), "region").otherwise("geoid")
    return rows.select("list_id", kind.alias("kind"), F.when(kind == "geoid", m).otherwise(F.substring(m, 3, 1_000_000)).alias("id"))


def region_members(lists: DataFrame, members: DataFrame, list_parents: DataFrame) -> DataFrame:
    """``seed, geoid``: the plots of ``lists(seed, node)`` and of all lists below; an id that is no list counts as a plot."""
    reached, _ = walk(lists, list_parents.select(F.col("parent").alias("source"), F.col("child").alias("target")))
    known = members.select(F.col("list_id").alias("node")).unionByName(list_parents.select(F.col("parent").alias("node"))).distinct()
    plots = reached.join(known, "node", "left_anti").select("seed", F.col("node").alias("geoid"))
    return reached.join(members, F.col("node") == F.col("list_id")).select("seed", "geoid").unionByName(plots).distinct()
