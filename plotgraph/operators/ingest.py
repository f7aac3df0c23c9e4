"""Importing fields and profiles: idempotent, with constraint checks, quarantine and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .lots import lot_roots
from .resolve import resolve_batch


def reason_of(error: Column) -> Column:
    """The text before the first colon, 60 characters at most."""
    return F.substring(F.trim(F.substring_index(error, ":", 1)), 1, 60)


def import_fields(fields: DataFrame, aliases: DataFrame, links: DataFrame, known_hashes: DataFrame | None = None, dry_run: bool = False, registered: DataFrame | None = None) -> DataFrame:
    """``v1_geo_id, outcome, target, parent``: what becomes of every field of an import.

    In a ``dry_run`` no field is registered, so none meets an earlier one of the
    same run: what no earlier run registered is ``new``.

    ``fields(v1_geo_id, position, error, content_hash, geo_id)``;
    ``aliases(v1_geo_id, geo_id)`` is what earlier runs wrote; ``links(a, b,
    relation, score)`` are verdicts between fields, ``registered(a, geo_id,
    relation, score)`` those between fields and plots of earlier runs, whose
    hashes are ``known_hashes(content_hash, geo_id)``.  In order:

    * ``skipped_already_done``: aliased before, so a second run changes nothing
    * ``quarantined:<reason>``: no geometry, or one that can't be used
    * ``same_as``: the content hash of a plot or of an earlier row, whose target it takes, or the same plot by its cover
    * ``new``, with ``parent`` if nested in an earlier plot

    A field that an earlier run registered under its own plot is a plot that
    later fields meet.  Hashes that are null equal nothing.
    """
    done = aliases.select("v1_geo_id", F.col("geo_id").alias("done")).dropDuplicates(["v1_geo_id"])
    rows = fields.join(done.hint("merge"), "v1_geo_id", "left")
    open_rows = rows.filter("done is null and error is null")
    # A row without a hash is a group of its own.
    same_hash = Window.partitionBy(F.coalesce("content_hash", F.concat(F.lit("none:"), F.col("v1_geo_id")))).orderBy("position", "v1_geo_id")
    lead = F.first("v1_geo_id").over(same_hash)
    open_rows = open_rows.withColumn("lead", F.col("v1_geo_id") if dry_run else lead)
    plots = rows.filter("done = geo_id and content_hash is not null").select("content_hash", "geo_id")
    if known_hashes is not None:
        plots = plots.unionByName(known_hashes.filter("content_hash is not null").select("content_hash", "geo_id"))
    open_rows = open_rows.join(plots.groupBy("content_hash").agg(F.min("geo_id").alias("held")).hint("merge"), "content_hash", "left")
    fresh = open_rows.filter("held is null and v1_geo_id = lead")
    field, plot = lambda c: F.concat(F.lit("field:"), F.col(c)), lambda c: F.concat(F.lit("plot:"), F.col(c))
    # The fields of earlier runs are known by their plots.
    nodes = fresh.select("v1_geo_id", field("v1_geo_id").alias("node")).unionByName(rows.filter("done = geo_id").select("v1_geo_id", plot("done").alias("node")))
    ends = lambda x: nodes.select(F.col("v1_geo_id").alias(x), F.col("node").alias(f"node_{x}"))
    linked = links.join(ends("a").hint("merge"), "a").join(ends("b").hint("merge"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "relation", "score")
    if dry_run:
        linked = linked.filter("a like 'plot:%' or b like 'plot:%'")
    if registered is not None:
        linked = linked.unionByName(registered.select(field("a").alias("a"), plot("geo_id").alias("b"), "relation", "score"))
    linked = cut(linked)
    ids = fresh.select(field("v1_geo_id").alias("id"), F.col("position").alias("at"), F.col("geo_id").alias("name"), F.lit(False).alias("registered"))
    held = linked.select(F.explode(F.array("a", "b")).alias("id")).filter("id like 'plot:%'").distinct().select("id", F.lit(None).cast("long").alias("at"), F.expr("substr(id, 6)").alias("name"), F.lit(True).alias("registered"))
    decided = resolve_batch(ids.unionByName(held), linked)
    names = ids.unionByName(held).select(F.col("id").alias("target"), F.col("name").alias("target_id"))
    decided = decided.join(names.hint("merge"), "target", "left").join(fresh.select(field("v1_geo_id").alias("id"), "v1_geo_id", "geo_id").hint("merge"), "id")
    same = F.col("outcome") == "same_as"
    none = F.lit(None).cast("string")
    decided = cut(decided.select("v1_geo_id", F.when(same, "same_as").otherwise("new").alias("outcome"), F.when(same, F.col("target_id")).otherwise(F.col("geo_id")).alias("target"), F.when(F.col("outcome") == "child_of", F.col("target_id")).alias("parent")))
    again = open_rows.filter("held is not null or v1_geo_id <> lead").select("v1_geo_id", "lead", "held")
    again = again.join(decided.select(F.col("v1_geo_id").alias("lead"), F.col("target").alias("led")).hint("merge"), "lead", "left")
    parts = [
        rows.filter("done is not null").select("v1_geo_id", F.lit("skipped_already_done").alias("outcome"), F.col("done").alias("target"), none.alias("parent")),
        rows.filter("done is null and error is not null").select("v1_geo_id", F.concat(F.lit("quarantined:"), reason_of(F.col("error"))).alias("outcome"), none.alias("target"), none.alias("parent")),
        again.select("v1_geo_id", F.lit("same_as").alias("outcome"), F.coalesce("held", "led").alias("target"), none.alias("parent")),
        decided,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(outcomes: DataFrame) -> DataFrame:
    """``outcome, fields, nested, first``: a row per outcome."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("fields"), F.count("parent").alias("nested"), F.min("v1_geo_id").alias("first"))


def new_aliases(outcomes: DataFrame) -> DataFrame:
    """The alias rows to append."""
    return outcomes.filter("outcome in ('same_as', 'new')").select("v1_geo_id", F.col("target").alias("geo_id"))


def run(fields: DataFrame, aliases: DataFrame, links: DataFrame, path: str, known_hashes: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """``report`` of an import that appends its aliases to ``path``; a ``dry_run`` goes the same way and writes nothing."""
    outcomes = cut(import_fields(fields, aliases, links, known_hashes, dry_run))
    if not dry_run:
        new_aliases(outcomes).write.mode("append").parquet(path)
    return report(outcomes)


def alias_upsert(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``v1_geo_id, geo_id, outcome`` of writing aliases: ``inserted``, ``unchanged``, or ``refused`` where another target is recorded.

    What one batch wants is decided in its order: the first row by ``position``
    (a column that may be there), then ``geo_id``, records the target; rows that
    repeat it are ``unchanged``, rows with another one ``refused``.  Null ids
    are ``refused``.
    """
    at = F.col("position") if "position" in wanted.columns else F.lit(0)
    first = wanted.filter("v1_geo_id is not null and geo_id is not null").groupBy("v1_geo_id").agg(F.min(F.struct(at.alias("at"), "geo_id")).alias("first"))
    known = existing.filter("v1_geo_id is not null").groupBy("v1_geo_id").agg(F.min("geo_id").alias("recorded"))
    held = first.join(known, "v1_geo_id", "left")
    # One row of those that bring the target is the one that is written.
    rows = wanted.withColumn("_row", F.row_number().over(Window.partitionBy("v1_geo_id", "geo_id").orderBy(at)))
    target = F.coalesce("recorded", "first.geo_id")
    outcome = F.when(F.col("geo_id") != target, "refused").when(F.col("recorded").isNotNull() | (F.col("_row") > 1), "unchanged").otherwise("inserted")
    return rows.join(held, "v1_geo_id", "left").select("v1_geo_id", "geo_id", F.when(F.col("first").isNull() | F.col("geo_id").isNull(), "refused").otherwise(outcome).alias("outcome"))


def parent_edges(edges: DataFrame, existing: DataFrame) -> DataFrame:
    """``child, parent`` edges to append: no edge to itself, none twice."""
    return edges.filter("child <> parent").select("child", "parent").distinct().join(existing, ["child", "parent"], "left_anti")


def uniqueness(rows: DataFrame) -> DataFrame:
    """``row, violation``: the first of full id, short id and content hash that an earlier row (by ``row``) has too."""
    again = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("row")) > 1
    r = rows
    for c in ("geo_id", "geo_id_short", "content_hash"):
        r = r.withColumn(f"_{c}", again(c))
    return r.select("row", F.when(F.col("_geo_id"), "geo_id").when(F.col("_geo_id_short"), "geo_id_short").when(F.col("_content_hash"), "content_hash").alias("violation"))


def accounts(profiles: DataFrame) -> DataFrame:
    """``source_key, outcome``: ``created``, or the constraint that refuses the account.

    In order: an email, a first and a last name are needed; of equal emails the
    first by ``position`` that is otherwise sound has it; client ids hold 50
    characters.  Phones may be missing or shared.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    broken = F.when(blank("email"), "email_not_null").when(blank("first_name") | blank("last_name"), "name_not_null").when(F.length("client_id") > 50, "client_id_length")
    rows = profiles.withColumn("broken", broken)
    rank = F.row_number().over(Window.partitionBy("email").orderBy("position"))
    sound = rows.filter("broken is null").select("source_key", F.when(rank > 1, "email_unique").otherwise("created").alias("outcome"))
    return sound.unionByName(rows.filter("broken is not null").select("source_key", F.col("broken").alias("outcome")))


def associations(claims: DataFrame, aliases: DataFrame, plots: DataFrame) -> DataFrame:
    """``source_key, v1_geo_id, geo_id, status`` of joining claims through the aliases.

    ``mapped``, ``v1_not_in_alias_table`` or ``alias_points_at_missing_geoid``.
    """
    a = claims.join(aliases.select("v1_geo_id", "geo_id").hint("merge"), "v1_geo_id", "left").join(plots.select("geo_id").distinct().withColumn("there", F.lit(True)).hint("merge"), "geo_id", "left")
    status = F.when(F.col("geo_id").isNull(), "v1_not_in_alias_table").when(F.col("there").isNull(), "alias_points_at_missing_geoid").otherwise("mapped")
    return a.select("source_key", "v1_geo_id", "geo_id", status.alias("status"))


def field_lists(mapped: DataFrame) -> DataFrame:
    """``source_key, list_id, n_plots``: a list per profile, named by the Merkle root over its distinct plots."""
    lists = lot_roots(mapped.filter("status = 'mapped'").select(F.col("source_key").alias("lot"), F.col("geo_id").alias("member")))
    return lists.select(F.col("lot").alias("source_key"), "list_id", F.col("n_members").alias("n_plots"))


def exit_code(outcomes: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row: 0 if all went in, 1 if some rows need a decision, 2 if nothing was imported."""
    o = outcomes.agg(F.count_if(F.col("outcome").isin("new", "same_as", "skipped_already_done")).alias("fine"), F.count_if(F.col("outcome").startswith("quarantined")).alias("quarantined"))
    m = mapped.agg(F.count_if(F.col("status") != "mapped").alias("failed"))
    code = F.when(F.col("fine") == 0, 2).when((F.col("quarantined") > 0) | (F.col("failed") > 0), 1).otherwise(0)
    return o.crossJoin(m).select("fine", "quarantined", "failed", code.alias("code"))  # one row each
