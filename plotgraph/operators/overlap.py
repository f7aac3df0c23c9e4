"""How far two covers overlap, exactly by area.

Cells are nested or disjoint, so with normalised covers a cell of one lies
wholly in a cell of the other or holds some of its cells: ancestors joined on
equality find both, without cutting cells up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.lineage import cut


def cover_overlap(pairs: DataFrame, covers: DataFrame) -> DataFrame:
    """``a, b, leaves_a, leaves_b, shared, iou, containment`` of every pair ``pairs(a, b)``.

    ``covers(owner, cell)`` are normalised (see ``cells.drop_covered`` for mixed
    levels), of any size, so no join is broadcast.  ``containment`` is the shared part of the smaller cover.  A cover
    without cells overlaps nothing: 0 in all.
    """
    each = covers.select("owner", "cell").distinct()
    # Of a cell only the ancestors at levels that the other cover has can be among its cells.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), cells.level(F.col("cell")))
    per = each.groupBy("owner").agg(F.sum(cells.leaf_count(F.col("cell"))).alias("leaves"), F.bit_or(bit).alias("levels"))
    wanted = pairs.select("a", "b").distinct()
    for x in ("a", "b"):
        wanted = wanted.join(per.select(F.col("owner").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("leaves", "levels")]).hint("merge"), x, "left")
    wanted = cut(wanted)

    def inside(x: str, y: str, proper: bool) -> DataFrame:
        """Leaves of x's cells that lie in a cell of y."""
        mine = wanted.join(each.withColumnRenamed("owner", x).withColumnRenamed("cell", "fine").hint("merge"), x).select("a", "b", "fine", F.col(f"levels_{y}").alias("levels"))
        finest = cells.level(F.col("fine"))
        held = lambda at: F.call_function("shiftright", F.col("levels"), at).bitwiseAND(F.lit(1)) == 1
        up = F.transform(F.filter(F.sequence(F.lit(0), finest), lambda at: held(at) & ((at < finest) if proper else F.lit(True))), lambda at: cells.parent(F.col("fine"), at))
        up = mine.select("a", "b", "fine", F.explode(up).alias("cell"))
        hit = up.join(each.withColumnRenamed("owner", y).hint("merge"), [y, "cell"])
        return hit.groupBy("a", "b").agg(F.sum(cells.leaf_count(F.col("fine"))).alias("leaves"))

    shared = inside("a", "b", False).unionByName(inside("b", "a", True)).groupBy("a", "b").agg(F.sum("leaves").alias("shared"))
    out = wanted.join(shared.hint("merge"), ["a", "b"], "left")
    zero = F.lit(0).cast("long")
    out = out.select("a", "b", *[F.coalesce(c, zero).alias(c) for c in ("leaves_a", "leaves_b", "shared")])
    union, least = F.col("leaves_a") + F.col("leaves_b") - F.col("shared"), F.least("leaves_a", "leaves_b")
    ratio = lambda of: F.when(least > 0, F.col("shared").cast("double") / of.cast("double")).otherwise(0.0)
    return out.select("*", ratio(union).alias("iou"), ratio(least).alias("containment"))


def shared_cells(pairs: DataFrame, covers: DataFrame) -> DataFrame:
    """``a, b, cell``: the normalised cover of what the covers of each pair ``pairs(a, b)`` share; none if nothing.

    Of two nested cells the finer one is shared, so no cell is cut.
    """
    wanted = pairs.select("a", "b").distinct().withColumn("owner", F.struct("a", "b"))
    each = covers.select("owner", "cell").distinct()
    lies = []
    for x, y in (("a", "b"), ("b", "a")):
        mine = wanted.join(each.withColumnRenamed("owner", x), x).select("owner", y, F.col("cell").alias("fine"))
        up = mine.select("owner", y, "fine", F.explode(cells.ancestors(F.col("fine"))).alias("cell"))
        lies.append(up.join(each.withColumnRenamed("owner", y), [y, "cell"]).select("owner", F.col("fine").alias("cell")))
    whole = cells.normalise(lies[0].unionByName(lies[1]).distinct())
    return whole.select("owner.a", "owner.b", "cell")


def token_overlap_percent(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``a, b, percent``: shared tokens by the larger of two token sets, in percent to two places; 0 if either is empty.

    ``tokens(owner, tokens array)``.  Half-way cases round up, where exact binary rounding may go down.
    """
    left, right = (tokens.select(F.col("owner").alias(x), F.array_distinct("tokens").alias(f"t{x}")) for x in "ab")
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    most = F.greatest(F.size("ta"), F.size("tb"))
    share = F.round(100.0 * F.size(F.array_intersect("ta", "tb")) / most, 2)
    return both.select("a", "b", F.when((F.size("ta") > 0) & (F.size("tb") > 0), share).otherwise(0.0).alias("percent"))
