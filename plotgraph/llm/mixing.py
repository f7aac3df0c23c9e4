"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, partitions, set_aside
from .groups import spread_join

#: Rows that one window task orders, about.
BLOCK_ROWS = 200_000


def _running(df: DataFrame, rows: int, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with a running sum within ``keys`` for each ``out: value`` of ``sums``, up to and with each row, in the order ``keys, order``.

    ``rows`` (the number of rows of ``df``) says in how many consecutive ranges
    the order is cut, by Spark's range partitioner: a key with many rows has
    many ranges.  The ranges are cut from the lineage, so that their sums and
    their rows are those of the same ranges.  Each range is ordered by a task
    of its own and starts from the sums of its key's ranges before it.
    """
    ranges = max(partitions(df.sparkSession), math.ceil(rows / BLOCK_ROWS))
    parts = cut(df.repartitionByRange(ranges, *keys, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most a row for each range and each key.
    starts = parts.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_{out}") for out, v in sums.items()])
    starts = starts.select(*keys, "_part", *[F.coalesce(F.sum(f"_{out}").over(before), F.lit(0)).alias(f"_{out}") for out in sums])
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select("*", *[F.sum(v).over(within).alias(out) for out, v in sums.items()])
    starts = starts.withColumnsRenamed({k: f"_at_{k}" for k in (*keys, "_part")})
    joined = parts.join(starts, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in (*keys, "_part")])
    return joined.select(*df.columns, *[(F.col(out) + F.col(f"_{out}")).alias(out) for out in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> tuple[DataFrame, float]:
    """``sizes(source, source_size, n_rows)`` with ``position`` and ``target``, the words that each source should give; and the sum of the targets.

    Sources by code point (null last) weigh ``weights``, repeating, and share
    ``share`` of all sizes; a target stops at ``repeats`` times its source's
    size and the excess goes to the others by weight until none is above.  The
    sources that stop are those with the least size per weight (ties: by
    position), so one running sum in that order finds them: a source stops if
    what is left after the ones before it, dealt by the weights that remain,
    reaches its limit.  From the first one that doesn't stop, all are dealt
    that one's share for each weight.  Any number of sources: both orders are
    cut in ranges.
    """
    sizes = cut(sizes)
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    by_name = [F.col("source").isNull(), F.col("source").cast("binary")]
    s = _running(sizes.withColumn("_one", F.lit(1).cast("long")), n, [], by_name, {"position": "_one"}).drop("_one")
    k = ((F.col("position") - 1) % len(weights) + 1).cast("int")
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), k)).withColumn("limit", (repeats * F.col("source_size")).cast("double"))
    s = cut(_running(s.withColumn("_ratio", F.col("limit") / F.col("weight")), n, [], [F.col("_ratio"), F.col("position")], {"limits": "limit", "dealt": "weight"}))
    every = s.agg(F.sum("weight")).first()[0] or 0.0
    left = share * total - (F.col("limits") - F.col("limit"))
    level = left / (F.lit(every) - (F.col("dealt") - F.col("weight")))
    first = s.select("_ratio", "position", level.alias("level")).filter(F.col("level") < F.col("_ratio")).agg(F.min(F.struct("_ratio", "position", "level"))).first()[0]
    target = F.col("limit")
    if first is not None:
        stops = (F.col("_ratio") < first["_ratio"]) | ((F.col("_ratio") == first["_ratio"]) & (F.col("position") < first["position"]))
        target = F.when(stops, F.col("limit")).otherwise(F.lit(first["level"]) * F.col("weight"))
    return s.select("source", "source_size", "n_rows", "position", target.alias("target")), min(share, repeats) * float(total)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 42) -> DataFrame:
    """How often the mix takes each document.

    A document's size is its number of words (null text: 0).  Every source is
    shuffled by a hash of id and text and queued in that order up to ``repeats``
    times.  A copy's virtual finish time is the words of its source up to it
    divided by the source's target; all copies are range-sorted by that time
    and taken as far as the budget (the sum of all targets) goes, so each
    source ends at about its target.  A source that stops at its limit is taken
    whole ``repeats`` times.

    Returns ``doc_id, source, size, source_size, target, copies, taken``, a row
    for each row of ``docs``.  Empty texts have size 0 and are taken as others
    are, with 0 words; all sizes zero give targets of 0 and nothing is taken.
    Null and repeated ids are rows like others; of fully equal rows the first
    ones in the queue are taken, whichever these are.  Empty tables give no rows.
    Reruns agree.  Texts are read once; every order is cut in ranges, so no
    source is ever ordered, summed or joined whole in one task.
    """
    base = cut(docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_row"), F.monotonically_increasing_id().alias("_id"),
    ))
    targets, budget = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, share, repeats)
    n = base.count()
    rows = spread_join(base, targets, ["source"], targets.select("source", F.col("n_rows").alias("_n"))).drop("n_rows")
    shuffled = [F.xxhash64(F.lit(seed), "_row"), F.col("_row"), F.col("doc_id"), F.col("_id")]
    rows = _running(rows, n, ["position"], shuffled, {"_words": "size"})
    copies = rows.filter("target > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.select("_id", "doc_id", "source", "size", "source_size", "target", "position", "_row", "_pass", ((F.col("_pass") * F.col("source_size") + F.col("_words")) / F.col("target")).alias("_finish"))
    queue = [F.col("_finish"), F.col("position"), F.col("_pass"), *shuffled]
    copies = _running(copies, n * repeats, [], queue, {"_filled": "size"}).withColumn("_copy", (F.col("_filled") <= math.ceil(budget)).cast("int"))
    named = ["_id", "doc_id", "_row", "source", "size", "source_size", "target"]
    rest = rows.filter("not target > 0").select(*named, F.lit(0).alias("_copy"))
    out = copies.select(*named, "_copy").unionByName(rest).groupBy(*named).agg(F.sum("_copy").cast("int").alias("copies"))
    return out.select("doc_id", "_row", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to ``repeats`` times), with the columns of ``docs``.

    Rows equal in id, text and source share what the mix takes of them: each is
    given as often as the others, and some of them once more where that doesn't
    come out even.  Null and repeated ids, empty texts and tables: see ``mix``.
    Columns of any name stay.
    """
    seed = parameters.get("seed", 42)
    keys = ["_d", "_r", "_s"]
    plan = mix(docs, **parameters).groupBy(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.col("source").alias("_s"))
    plan = cut(plan.agg(F.sum("copies").alias("_sum"), F.count("*").alias("_n")).filter("_sum > 0"))
    rows, back = set_aside(docs)
    rows = rows.withColumns({"_d": F.col("doc_id"), "_r": F.xxhash64(F.lit(seed), "doc_id", "text"), "_s": F.col("source")})
    even, odd = F.floor(F.col("_sum") / F.col("_n")), F.col("_sum") % F.col("_n")
    given = spread_join(rows, plan.filter(odd == 0), keys, plan).withColumn("_k", even)
    # Only equal rows can share unevenly; where none do, the texts are not joined again.
    uneven = plan.filter(odd > 0)
    n = uneven.agg(F.sum("_n")).first()[0]
    if n:
        shared = spread_join(rows, uneven, keys, uneven).withColumns({"_one": F.lit(1).cast("long"), "_id": F.monotonically_increasing_id()})
        shared = _running(shared, n, keys, [F.col("_id")], {"_k": "_one"}).drop("_one", "_id")
        given = given.unionByName(shared.withColumn("_k", even + (F.col("_k") <= odd).cast("long")))
    return given.filter("_k > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).select(*back)
