"""Profiling a legacy source, and choosing a sample of its hazards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.lineage import cut

#: Hazards in the order in which a tight budget keeps them; area bands follow by name.
PRIORITY = (
    "multi_owner_cluster", "l13_collision_cluster", "uuid_fallback", "l20_fallback", "no_geometry", "unparseable_geometry", "zero_or_missing_area",
    "profile_with_orphan_ref", "unclaimed_field", "profile_with_many_fields",
)
MANY_FIELDS = 10
#: At most so many ids are sent to every task.
SENT = 200_000


def area_band(area: Column) -> Column:
    """Fixed bands of hectares."""
    band = F.when(area.isNull(), "unknown").when(area <= 0, "zero")
    for limit, name in ((1, "<1"), (5, "1-5"), (50, "5-50"), (500, "50-500")):
        band = band.when(area < limit, name)
    return band.otherwise(">500")


def classify_id(v1: Column, l13_hash: Column) -> Column:
    """What an older id is: a UUID, the hash of its level-13 cells, another hash, or unknown."""
    uuid = (F.length(v1) == 36) & (F.regexp_count(v1, F.lit("-")) == 4)
    hashed = v1.rlike("^[0-9a-fA-F]{64}$")
    return F.when(uuid, "uuid").when(hashed & (l13_hash.isNull() | (v1 == l13_hash)), "l13_hash").when(hashed, "l20_hash").otherwise("unknown")


def has_geometry(wkt: Column) -> Column:
    return F.coalesce(F.length(F.trim(wkt)) > 0, F.lit(False))


def parseable(wkt: Column) -> Column:
    return has_geometry(wkt) & geometry.from_wkt(wkt).isNotNull()


def fields_inventory(fields: DataFrame) -> DataFrame:
    """One row of counts over ``fields(v1_geo_id, kind, l13, wkt, area)``."""
    key = F.coalesce("l13", "v1_geo_id")
    flat = parseable(F.col("wkt")) & (geometry.total_area(geometry.from_wkt(F.col("wkt"))) <= 0)
    counts = fields.agg(
        F.count("*").alias("total_fields"), F.count_if(has_geometry(F.col("wkt"))).alias("with_geometry"), F.count_if(parseable(F.col("wkt"))).alias("parseable_geometry"),
        F.count_if(flat).alias("zero_or_invalid_area"), F.countDistinct(key).alias("distinct_keys"),
    )
    return counts.withColumn("collisions", F.col("total_fields") - F.col("distinct_keys"))


def kind_counts(fields: DataFrame) -> DataFrame:
    return fields.groupBy("kind").agg(F.count("*").alias("fields"))


def band_counts(fields: DataFrame) -> DataFrame:
    return fields.groupBy(area_band(F.col("area")).alias("band")).agg(F.count("*").alias("fields"))


def profiles_inventory(profiles: DataFrame, claims: DataFrame) -> DataFrame:
    """One row of counts over ``profiles(source_key, email, phone)`` and ``claims(source_key, v1_geo_id)``."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    each = claims.groupBy("source_key").agg(F.count("*").alias("n"))
    rows = profiles.join(each, "source_key", "left")
    base = rows.agg(F.count("*").alias("total_profiles"), F.count_if(F.coalesce("n", F.lit(0)) > 0).alias("profiles_with_fields"), F.coalesce(F.max("n"), F.lit(0)).alias("max_fields"), F.count_if(blank("email")).alias("missing_email"), F.count_if(blank("phone")).alias("missing_phone"))
    twice = [profiles.filter(~blank(c)).groupBy(c).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"duplicate_{c}s")) for c in ("email", "phone")]
    return base.crossJoin(twice[0]).crossJoin(twice[1])  # one row each


def join_health(fields: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: references to unknown fields, fields nobody claims, ids with several owners."""
    known = fields.select("v1_geo_id").distinct()
    orphans = claims.join(known, "v1_geo_id", "left_anti").agg(F.count("*").alias("orphan_refs"))
    unclaimed = known.join(claims.select("v1_geo_id").distinct(), "v1_geo_id", "left_anti").agg(F.count("*").alias("unclaimed_fields"))
    several = claims.groupBy("v1_geo_id").agg(F.countDistinct("source_key").alias("n")).agg(F.count_if(F.col("n") > 1).alias("multi_owner_ids"))
    return orphans.crossJoin(unclaimed).crossJoin(several)  # one row each


def orphan_refs(fields: DataFrame, claims: DataFrame) -> DataFrame:
    return claims.join(fields.select("v1_geo_id").distinct().hint("merge"), "v1_geo_id", "left_anti").select("source_key", "v1_geo_id")


def unclaimed_fields(fields: DataFrame, claims: DataFrame) -> DataFrame:
    return fields.select("v1_geo_id").distinct().join(claims.select("v1_geo_id").distinct(), "v1_geo_id", "left_anti")


def multi_owner(claims: DataFrame) -> DataFrame:
    """``v1_geo_id, owners``: ids that several profiles claim."""
    owners = claims.groupBy("v1_geo_id").agg(F.array_sort(F.collect_set("source_key")).alias("owners"))
    return owners.filter(F.size("owners") > 1)


def clusters(fields: DataFrame, claims: DataFrame) -> DataFrame:
    """``key, members, owners, stratum``: level-13 keys shared by fields, and whether several profiles claim among them."""
    keyed = fields.select(F.coalesce("l13", "v1_geo_id").alias("key"), "v1_geo_id")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members >= 2")
    owned = keyed.join(claims.hint("merge"), "v1_geo_id").groupBy("key").agg(F.countDistinct("source_key").alias("owners"))
    out = sizes.join(owned.hint("merge"), "key", "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    return out.withColumn("stratum", F.when(F.col("owners") > 1, PRIORITY[0]).otherwise(PRIORITY[1]))


def claimed(claims: DataFrame) -> DataFrame:
    """``v1_geo_id, least, most``: the ids that are claimed, with the first and the last of their owners."""
    return cut(claims.groupBy("v1_geo_id").agg(F.min("source_key").alias("least"), F.max("source_key").alias("most")))


def marked(claims: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``claims`` with ``name``: whether its id is one of ``ids(v1_geo_id)`` or missing.

    A checked bound: up to ``SENT`` ids are sent to the claims, which needs no
    shuffle of them; more meet them by sorting.
    """
    ids = cut(ids.filter("v1_geo_id is not null").select("v1_geo_id").distinct().withColumn(name, F.lit(True)))
    found = claims.join(F.broadcast(ids) if ids.count() <= SENT else ids.hint("merge"), "v1_geo_id", "left")
    return found.withColumn(name, F.col("v1_geo_id").isNull() | F.coalesce(name, F.lit(False)))


def unknown(fields: DataFrame, ids: DataFrame) -> DataFrame:
    """Of ``claimed`` ids those of no field."""
    return ids.select("v1_geo_id").join(fields.select("v1_geo_id").distinct().hint("merge"), "v1_geo_id", "left_anti")


def _first_claims(claims: DataFrame, strange: DataFrame, cap: int) -> DataFrame:
    """``stratum, v1_geo_id, x, y``: known claims of profiles with a reference to an unknown field, and of those with many fields, with the first ``cap`` ids of each.

    Claims are read up to the place of the ``cap``-th such profile, and all of
    them only if those hold fewer than ``cap`` ids: a claim beyond the place
    comes after all that are read.
    """
    per = marked(claims, strange, "lost").groupBy("source_key").agg(F.max("lost").alias("lost"), F.count("*").alias("n"), F.max("position").alias("last"))
    held = {PRIORITY[7]: F.col("lost"), PRIORITY[9]: F.col("n") >= MANY_FIELDS}
    per = cut(per.filter(held[PRIORITY[7]] | held[PRIORITY[9]]))
    flags = per.select("source_key", *[c.alias(name) for name, c in held.items()])
    wanted = {PRIORITY[7]: F.lit(True), PRIORITY[9]: F.col("item") < cap}

    lasts = {name: per.filter(condition & F.col("last").isNotNull()).select("last").orderBy("last").limit(cap).agg(F.max("last")).first()[0] for name, condition in held.items()}

    def of(names: list[str], whole: bool) -> DataFrame:
        """The claims of ``names`` up to their places, or all.  A claim without a position comes before the others."""
        up_to = lambda last: F.col("position").isNull() if last is None else F.col("position").isNull() | (F.col("position") <= last)
        rows = claims if whole else claims.filter(up_to(max((x for x in lasts.values() if x is not None), default=None)))
        fits = F.array(*[F.when(F.col(name) & wanted[name] & (F.lit(True) if whole else up_to(lasts[name])), F.lit(name)) for name in names])
        found = rows.join(flags.hint("merge"), "source_key").withColumn("names", F.array_compact(fits)).filter(F.size("names") > 0)
        found = marked(found, strange, "unknown").filter(~F.col("unknown"))
        return cut(found.select(F.explode("names").alias("stratum"), "v1_geo_id", F.col("position").alias("x"), F.col("item").alias("y")))

    first, few = of(list(held), False), []
    for name, condition in held.items():
        more = lasts[name] is not None and not per.filter(condition & (F.col("last") > lasts[name])).isEmpty()
        if more and first.filter(F.col("stratum") == name).select("v1_geo_id").distinct().count() < cap:
            few.append(name)
    return first.filter(~F.col("stratum").isin(few)).unionByName(of(few, True)) if few else first


def strata(fields: DataFrame, claims: DataFrame, cap: int = 200, ids: DataFrame | None = None) -> DataFrame:
    """``stratum, v1_geo_id, place``: the members of each hazard in order, without repeats, at most ``cap`` of each.

    ``fields`` also has ``position``; ``claims`` also ``position`` (of the
    profile) and ``item`` (of the claim in it).  ``ids``: ``claimed(claims)``,
    if it is there already.
    """
    ids = claimed(claims) if ids is None else ids
    f = fields.select("v1_geo_id", "position", "kind", "wkt", "area", F.coalesce("l13", "v1_geo_id").alias("key"))
    # Whether several profiles claim among the fields of a key is seen by the first and the last of them.
    owners = f.select("key", "v1_geo_id").join(ids.hint("merge"), "v1_geo_id").groupBy("key").agg((F.min("least") != F.max("most")).alias("several"))
    groups = f.groupBy("key").agg(F.count("*").alias("members"), F.min("position").alias("start")).filter("members >= 2").join(owners.hint("merge"), "key", "left")
    groups = groups.select("key", "start", F.when(F.col("several"), PRIORITY[0]).otherwise(PRIORITY[1]).alias("stratum"))
    clustered = groups.join(f.select("key", "v1_geo_id", "position").hint("merge"), "key").select("stratum", "v1_geo_id", F.col("start").alias("x"), F.col("position").alias("y"))
    zero = F.lit(0).cast("long")

    def of(name: str, condition: Column) -> DataFrame:
        return f.filter(condition).select(F.lit(name).alias("stratum"), "v1_geo_id", F.col("position").alias("x"), zero.alias("y"))

    parts = [
        clustered, of(PRIORITY[2], F.col("kind") == "uuid"), of(PRIORITY[3], F.col("kind") == "l20_hash"), of(PRIORITY[4], ~has_geometry(F.col("wkt"))),
        of(PRIORITY[5], has_geometry(F.col("wkt")) & ~parseable(F.col("wkt"))), of(PRIORITY[6], F.coalesce(F.col("area") <= 0, F.lit(True))), _first_claims(claims, unknown(fields, ids), cap),
        f.join(ids.select("v1_geo_id").hint("merge"), "v1_geo_id", "left_anti").select(F.lit(PRIORITY[8]).alias("stratum"), "v1_geo_id", F.col("position").alias("x"), zero.alias("y")),
        f.select(F.concat(F.lit("area_"), area_band(F.col("area"))).alias("stratum"), "v1_geo_id", F.col("position").alias("x"), zero.alias("y")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = every.groupBy("stratum", "v1_geo_id").agg(F.min(F.struct("x", "y")).alias("at"))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("at", "v1_geo_id"))
    return once.withColumn("place", place).filter(F.col("place") <= cap).select("stratum", "v1_geo_id", "place")


def budgeted_sample(fields: DataFrame, claims: DataFrame, budget: int = 3000, cap: int = 200, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``stratum, v1_geo_id`` of the sample, and one row of its figures.

    Strata are taken in order of priority while there is room.  An id chosen
    before still fills a place of a later stratum.  Only if no stratum was cut,
    other fields fill the sample up to the budget (stratum ``filler``).
    ``ids`` as in ``strata``.
    """
    listed = cut(strata(fields, claims, cap, ids))
    names = [r[0] for r in listed.select("stratum").distinct().collect()]  # 17 at most
    ordered = [n for n in PRIORITY if n in names] + sorted(n for n in names if n.startswith("area_"))
    taken, chosen, size, exhausted = None, None, 0, False
    for name in ordered:
        room = budget - size
        members = listed.filter(F.col("stratum") == name)
        exhausted = exhausted or room < members.count()
        take = members.filter(F.col("place") <= max(room, 0)).select("stratum", "v1_geo_id")
        taken = take if taken is None else taken.unionByName(take)
        chosen = cut(taken.select("v1_geo_id").distinct())
        size = chosen.count()
    filler = 0
    if not exhausted and taken is not None and size < budget:
        rest = fields.join(chosen, "v1_geo_id", "left_anti").groupBy("v1_geo_id").agg(F.min("position").alias("position")).orderBy("position").limit(budget - size)
        extra = cut(rest.select(F.lit("filler").alias("stratum"), "v1_geo_id"))
        filler = extra.count()
        taken = taken.unionByName(extra)
    if taken is None:
        taken = listed.select("stratum", "v1_geo_id")
    figures = fields.sparkSession.createDataFrame([(budget, size + filler, filler, exhausted)], "budget int, chosen int, filler int, exhausted boolean")
    return taken, figures


def sampled_profiles(profiles: DataFrame, claims: DataFrame, fields: DataFrame, chosen: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``source_key`` of profiles that own a chosen field, have none, or hold a reference to an unknown field.  ``ids`` as in ``strata``."""
    strange = unknown(fields, claimed(claims) if ids is None else ids)
    hits = marked(claims, chosen.select("v1_geo_id").unionByName(strange), "hit").groupBy("source_key").agg(F.max("hit").alias("hit"))
    every = profiles.filter("source_key is not null").select("source_key").distinct().join(hits.hint("merge"), "source_key", "left")
    return every.filter(F.coalesce("hit", F.lit(True))).select("source_key")
