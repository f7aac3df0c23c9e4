"""Lots and regions named by what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells, digests
from ..functions.lineage import cut, numbered


#: Leaves below a node that one expression folds: ten levels of a tree; and members of a lot whose proofs one expression states.
BLOCK, FEW = 1024, 64


def _distinct(members: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``lot, m`` (sorted array) of lots with up to ``most`` members, and ``lot, member`` of the larger ones, None if there are none."""
    rows = cut(members.filter("member is not null").select("lot", "member").distinct())
    sizes = rows.groupBy("lot").agg(F.count("*").alias("n"))
    large = cut(sizes.filter(F.col("n") > most).select("lot"))
    if large.isEmpty():
        return rows.groupBy("lot").agg(F.array_sort(F.collect_list("member")).alias("m")), None
    small = rows.join(large, "lot", "left_anti").groupBy("lot").agg(F.array_sort(F.collect_list("member")).alias("m"))
    return small, rows.join(large, "lot", "left_semi")


def _levels(members: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The leaves ``lot, member, i, node, n`` of each lot's tree, and its levels from the leaves' parents up.

    A level has a row for each node: ``lot, i, node, n`` (nodes of the lot at
    that level), ``left`` and ``right`` (its children; an odd node moves up
    unchanged and has no right one).  A level is a grouping of the one below by
    lot and half of the index, so no row or task holds a tree.
    """
    distinct = members.filter("member is not null").select("lot", "member").distinct()
    placed = numbered(distinct, "lot", [F.col("member")])
    n = placed.groupBy("lot").agg(F.count("*").alias("n"))
    leaves = cut(placed.join(n, "lot").withColumn("node", digests.sha256_raw(F.col("member").cast("binary"))))
    levels, below = [], leaves.filter("n > 1")
    while below.head(1):
        pair = F.array_sort(F.collect_list(F.struct("i", "node")))
        up = below.groupBy("lot", F.floor(F.col("i") / 2).alias("i"), F.ceil(F.col("n") / 2).alias("n")).agg(pair.alias("p"))
        up = up.select("lot", "i", "n", F.col("p")[0]["node"].alias("left"), F.get("p", F.lit(1))["node"].alias("right"))
        up = cut(up.withColumn("node", F.when(F.col("right").isNull(), F.col("left")).otherwise(digests.sha256_raw(F.concat("left", "right")))))
        levels.append(up)
        below = up.filter("n > 1")
    return leaves, levels


def _roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``lot, list_id`` from the rows that are alone at their level."""
    roots = leaves.filter("n = 1").select("lot", "node")
    for level in levels:
        roots = roots.unionByName(level.filter("n = 1").select("lot", "node"))
    return roots.select("lot", F.lower(F.hex("node")).alias("list_id"))


def _large_roots(members: DataFrame) -> DataFrame:
    """``lot, n_members, list_id`` of large lots: blocks of leaves are folded apart, then the nodes above them, so a round is ten levels."""
    placed = numbered(members, "lot", [F.col("member")])
    n = placed.groupBy("lot").agg(F.count("*").alias("n_members"))
    nodes = cut(placed.select("lot", "i", digests.sha256_raw(F.col("member").cast("binary")).alias("node")))
    size = n.agg(F.max("n_members")).first()[0]
    while size > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"])
        nodes = cut(nodes.groupBy("lot", F.floor(F.col("i") / BLOCK).alias("i")).agg(run.alias("run")).select("lot", "i", digests.fold(F.col("run")).alias("node")))
        size = -(-size // BLOCK)
    return nodes.join(n, "lot").select("lot", "n_members", F.lower(F.hex("node")).alias("list_id"))


def lot_roots(members: DataFrame) -> DataFrame:
    """``lot, n_members, list_id``: the Merkle root over each lot's distinct members ``(lot, member)``.

    Lots of up to BLOCK members are one expression each; the trees of larger
    ones are folded in blocks of that many nodes, so no task holds a large lot.
    """
    small, large = _distinct(members, BLOCK)
    roots = small.select("lot", F.size("m").cast("long").alias("n_members"), digests.merkle_root(F.col("m")).alias("list_id"))
    return roots if large is None else roots.unionByName(_large_roots(large))


def lot_proofs(members: DataFrame) -> DataFrame:
    """``lot, member, list_id, proof, verified`` for every member of every lot.

    Lots of up to FEW members are one expression each.  In larger ones proofs
    are handed down from the roots: a node's proof is its sibling and its
    parent's proof, so each level is one join on a node's own place.
    """
    small, large = _distinct(members, FEW)
    each = small.select("lot", digests.merkle_root(F.col("m")).alias("list_id"), F.explode(digests.inclusion_proofs(F.col("m"))).alias("p")).select("lot", "p.member", "list_id", "p.proof")
    rows = each if large is None else each.unionByName(_large_proofs(large))
    return rows.select("lot", "member", "list_id", "proof", digests.verify_inclusion(F.col("member"), F.col("proof"), F.col("list_id")).alias("verified"))


def _large_proofs(members: DataFrame) -> DataFrame:
    """``lot, member, list_id, proof`` by rows, level by level."""
    leaves, levels = _levels(members)
    nothing = F.array().cast("array<struct<sibling:string,position:string>>")
    paths = None
    for at in range(len(levels) - 1, -1, -1):
        level = levels[at]
        top = level.filter("n = 1").withColumn("proof", nothing)
        if paths is not None:
            top = top.unionByName(level.filter("n > 1").join(paths, ["lot", "i"]))
        step = lambda node, position: F.array(F.struct(F.lower(F.hex(node)).alias("sibling"), F.lit(position).alias("position")))
        alone = F.col("right").isNull()
        left = F.struct((F.col("i") * 2).alias("i"), F.when(alone, F.col("proof")).otherwise(F.concat(step("right", "right"), "proof")).alias("proof"))
        right = F.struct((F.col("i") * 2 + 1).alias("i"), F.concat(step("left", "left"), "proof").alias("proof"))
        paths = cut(top.select("lot", F.explode(F.when(alone, F.array(left)).otherwise(F.array(left, right))).alias("c")).select("lot", "c.i", "c.proof"))
    single = leaves.filter("n = 1").select("lot", "member", nothing.alias("proof"))
    rows = single if paths is None else single.unionByName(leaves.filter("n > 1").join(paths, ["lot", "i"]).select("lot", "member", "proof"))
    return rows.join(_roots(leaves, levels), "lot").select("lot", "member", "list_id", "proof")


def register_lots(wanted: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcome of registering ``wanted(lot, member)``, and the artifacts to append.

    Lots with equal members are one artifact.  Outcomes: ``registered``,
    ``exists`` (in ``existing(list_id)``), ``empty``.  Appending what is
    returned and registering again changes nothing.
    """
    roots = lot_roots(wanted)
    known = existing.select("list_id").distinct().withColumn("known", F.lit(True))
    lots = wanted.select("lot").distinct().join(roots, "lot", "left").join(known, "list_id", "left")
    outcome = F.when(F.col("list_id").isNull(), "empty").when(F.col("known"), "exists").otherwise("registered")
    report = lots.select("lot", "list_id", outcome.alias("outcome"))
    return report, report.filter("outcome = 'registered'").select("list_id").distinct()


def register_regions(covers: DataFrame) -> DataFrame:
    """``owner, region_id, n_cells``: the region of each owner's cells, named by the digest of its normalised cover.

    ``covers(owner, cell)``.  Owners without cells have no region.
    """
    whole = cells.normalise(covers)
    tokens = whole.groupBy("owner").agg(F.collect_set(cells.id_to_token(F.col("cell"))).alias("t"))
    return tokens.select("owner", digests.region_digest(F.col("t")).alias("region_id"), F.size("t").cast("long").alias("n_cells"))
