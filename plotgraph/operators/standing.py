"""Imports against a standing registry: what every earlier import registered is met by its hash and by its cover.

The registry is a ledger of tables.  Covers are stored by blocking cell, split
into areas (the cells of one coarse level), so that an import reads the covers
of its own areas only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.lineage import cut
from ..sources.ledger import Ledger
from . import ingest, overlap, resolve

#: Areas are the cells of this level: 24,576 at most, and one for coarser cells.
AREA_LEVEL, BLOCKING_LEVEL = 6, 13
SCHEMAS = {
    "plots": "geo_id string, content_hash string",
    "covers": "geo_id string, cell long, key long, area long",
    "aliases": "v1_geo_id string, geo_id string",
    "parents": "child string, parent string",
    "outcomes": "v1_geo_id string, outcome string, target string, parent string",
    "associations": "source_key string, v1_geo_id string, geo_id string, status string",
}


def registry(spark: SparkSession, folder: str) -> Ledger:
    return Ledger(spark, folder, SCHEMAS, {"covers": ["area"]})


def blocking(cell: Column) -> Column:
    return F.when(cells.level(cell) > BLOCKING_LEVEL, cells.parent(cell, BLOCKING_LEVEL)).otherwise(cell)


def area(key: Column) -> Column:
    """The area of a blocking cell; 0 for one that spans several."""
    return F.when(cells.level(key) >= AREA_LEVEL, cells.parent(key, AREA_LEVEL)).otherwise(F.lit(0).cast("long"))


def indexed(covers: DataFrame) -> DataFrame:
    """``geo_id, cell, key, area`` of ``covers(geo_id, cell)``."""
    return covers.select("geo_id", "cell", blocking(F.col("cell")).alias("key")).withColumn("area", area(F.col("key"))).distinct()


def held_covers(held: Ledger, mine: DataFrame) -> DataFrame:
    """The registered covers in the areas of ``mine(key, area)``; the areas are at most as many as there are cells of their level."""
    areas = [r["area"] for r in mine.select("area").distinct().collect()]
    return held.read("covers").filter(F.col("area").isin(areas))


def links(covers: DataFrame, held: DataFrame, threshold: float = 95.0) -> DataFrame:
    """``a, b, relation, score``: verdicts between the plots ``covers(geo_id, cell, key)`` and those in ``held``, and among themselves.

    Cells coarser than the blocking level meet only plots that list them too.
    """
    owned = lambda df: df.select(F.col("geo_id").alias("owner"), "cell").distinct()
    both = covers.select("geo_id", "cell", "key").unionByName(held.select("geo_id", "cell", "key"))
    left = covers.select(F.col("geo_id").alias("a"), "key").distinct()
    pairs = cut(left.join(both.select(F.col("geo_id").alias("b"), "key").distinct(), "key").filter("a <> b").select("a", "b").distinct())
    needed = owned(both).join(pairs.select(F.explode(F.array("a", "b")).alias("owner")).distinct(), "owner", "left_semi")
    return resolve.verdicts(overlap.cover_overlap(pairs, needed), threshold)


def import_batch(held: Ledger, batch: str, fields: DataFrame, covers: DataFrame, threshold: float = 95.0, dry_run: bool = False) -> DataFrame:
    """``v1_geo_id, outcome, target, parent`` of importing ``fields`` (see ``ingest.import_fields``) with ``covers(geo_id, cell)`` into the registry.

    Fields meet the plots of all committed batches as they meet earlier fields
    of their own, so an import in several runs, or one that was resumed after
    any row, gives what a single one gives.  A batch that was committed isn't
    run again; its outcomes are read.  Plots, covers, aliases, parents and
    outcomes are committed together.  A ``dry_run`` writes nothing.
    """
    if held.committed(batch, "fields"):
        return held.read("outcomes", batch).drop("batch")
    aliases = held.read("aliases")
    mine = fields.filter("error is null").join(aliases, "v1_geo_id", "left_anti")
    index = cut(indexed(covers.join(mine.select("geo_id").distinct(), "geo_id", "left_semi")))
    verdicts = cut(links(index, held_covers(held, index), threshold))
    named = lambda x: mine.select(F.col("geo_id").alias(x), F.col("v1_geo_id").alias(f"v1_{x}"))
    within = verdicts.join(named("a"), "a").join(named("b"), "b").select(F.col("v1_a").alias("a"), F.col("v1_b").alias("b"), "relation", "score")
    # Fields of one cover are the same plot: each is linked to the first, which is canonical or goes where they go.
    first = mine.filter("geo_id is not null").groupBy("geo_id").agg(F.min_by("v1_geo_id", F.struct("position", "v1_geo_id")).alias("b"))
    twins = mine.join(first, "geo_id").filter("v1_geo_id <> b").select(F.col("v1_geo_id").alias("a"), "b", F.lit("same_as").alias("relation"), F.lit(1.0).alias("score"))
    plots = held.read("plots").select("geo_id", "content_hash")
    other = verdicts.join(plots.select(F.col("geo_id").alias("b")), "b", "left_semi").join(named("a"), "a").select(F.col("v1_a").alias("a"), F.col("b").alias("geo_id"), "relation", "score")
    known = mine.join(plots.select("geo_id"), "geo_id", "left_semi").select(F.col("v1_geo_id").alias("a"), "geo_id", F.lit("same_as").alias("relation"), F.lit(1.0).alias("score"))
    outcomes = cut(ingest.import_fields(fields, aliases, within.unionByName(twins), plots, dry_run, other.unionByName(known)))
    if not dry_run:
        held.write(batch, "fields", lambda: _tables(outcomes, fields, index))
    return outcomes


def _tables(outcomes: DataFrame, fields: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    new = outcomes.filter("outcome = 'new'").select("v1_geo_id", "target", "parent")
    plots = new.join(fields.select("v1_geo_id", "content_hash"), "v1_geo_id").select(F.col("target").alias("geo_id"), "content_hash")
    return {
        "plots": plots,
        "covers": index.join(plots.select("geo_id"), "geo_id", "left_semi").repartition("area"),
        "aliases": ingest.new_aliases(outcomes),
        "parents": new.filter("parent is not null").select(F.col("target").alias("child"), "parent"),
        "outcomes": outcomes,
    }


def associate_batch(held: Ledger, batch: str, claims: DataFrame) -> DataFrame:
    """The second phase of a batch: ``ingest.associations`` of ``claims(source_key, v1_geo_id)`` through all committed aliases, committed once."""
    held.write(batch, "associations", lambda: {"associations": ingest.associations(claims, held.read("aliases"), held.read("plots"))})
    return held.read("associations", batch).drop("batch")
