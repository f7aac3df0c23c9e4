"""Queries over the legacy source, its import, and credentials."""

from __future__ import annotations

import base64
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import credentials, ingest, inventory, resolve, standing
from . import lenses
from .cell_queries import _SCORED, _SCORED_VIEWS, _scored
from .lenses import named, read, sql


def fields(spark: SparkSession, d: str) -> DataFrame:
    """Parts as fields of a legacy registry."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    digest = F.sha2(k.cast("string"), 256)
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    v1 = F.when(k % 4 == 1, uuid).when(k % 4 == 3, F.concat(F.lit("x"), k.cast("string"))).otherwise(digest)
    own = F.when(k % 4 == 0, digest).otherwise(F.sha2("p_brand", 256))
    wkt = F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, "NOT WKT AT ALL").when(k % 29 == 0, "  ").otherwise(F.concat(F.lit("POINT ("), k.cast("string"), F.lit(" 1)")))
    area = F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, 0.0).otherwise(F.col("p_size") * 12.5 / (k % 7 + 1))
    return p.select(
        v1.alias("v1_geo_id"), k.alias("position"), inventory.classify_id(v1, own).alias("kind"), F.when(k % 5 != 0, F.sha2(F.concat("p_brand", F.lit("l13")), 256)).alias("l13"),
        wkt.cast("string").alias("wkt"), area.cast("double").alias("area"), F.col("p_partkey").alias("k"),
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Customers as profiles, some without email, phone or names, some sharing them."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    email = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "shared@example.com").otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")))
    phone = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("+1"), (k - k % 3).cast("string")))
    return c.select(named("T", k).alias("source_key"), k.alias("position"), email.cast("string").alias("email"), phone.alias("phone"), F.when(k % 31 != 0, F.lit("A")).alias("first_name"), F.when(k % 37 == 0, "").otherwise("B").alias("last_name"), F.when(k % 41 == 0, F.repeat(F.lit("c"), 51)).otherwise("c").alias("client_id"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Every line claims, for its customer, the field that begins its part's group of three (so fields inside groups are unclaimed); some customers claim a field that isn't there."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    pairs = o.join(li.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), (F.col("l_partkey") - F.col("l_partkey") % 3).alias("k"))
    # Dealt by k alone, pairs are made distinct where they meet their fields.
    pairs = pairs.repartition("k").distinct()
    f = fields(spark, d).select("k", "v1_geo_id")
    known = pairs.join(f.hint("merge"), "k").select("c", "k", "v1_geo_id")
    stray = read(spark, d, "customer").filter("c_custkey % 37 = 0").select(F.col("c_custkey").alias("c"), F.lit(1 << 40).cast("long").alias("k"), F.concat(F.lit("orphan-"), F.col("c_custkey").cast("string")).alias("v1_geo_id"))
    from pyspark.sql import Window

    # The window is over the column that is returned, so a filter of profiles' positions comes before it.
    every = known.unionByName(stray).select(named("T", F.col("c")).alias("source_key"), F.col("c").alias("position"), "k", "v1_geo_id")
    item = F.row_number().over(Window.partitionBy("position").orderBy("k")) - 1
    return every.select("source_key", "position", item.cast("long").alias("item"), "v1_geo_id")


def id_kinds(spark: SparkSession, d: str) -> DataFrame:
    return fields(spark, d).select("position", "kind")


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return inventory.kind_counts(fields(spark, d))


def area_bands(spark: SparkSession, d: str) -> DataFrame:
    return inventory.band_counts(fields(spark, d))


def inventory_fields(spark: SparkSession, d: str) -> DataFrame:
    return inventory.fields_inventory(fields(spark, d))


def inventory_profiles(spark: SparkSession, d: str) -> DataFrame:
    return inventory.profiles_inventory(profiles(spark, d), claims(spark, d))


def inventory_join_health(spark: SparkSession, d: str) -> DataFrame:
    return inventory.join_health(fields(spark, d), claims(spark, d))


def orphan_refs(spark: SparkSession, d: str) -> DataFrame:
    return inventory.orphan_refs(fields(spark, d), claims(spark, d))


def unclaimed_fields(spark: SparkSession, d: str) -> DataFrame:
    return inventory.unclaimed_fields(fields(spark, d), claims(spark, d))


def multi_owner(spark: SparkSession, d: str) -> DataFrame:
    return inventory.multi_owner(claims(spark, d)).select("v1_geo_id", F.size("owners").alias("n_owners"), F.get("owners", F.lit(0)).alias("first_owner"))


def sample_clusters(spark: SparkSession, d: str) -> DataFrame:
    return inventory.clusters(fields(spark, d), claims(spark, d))


def sample_strata(spark: SparkSession, d: str) -> DataFrame:
    return inventory.strata(fields(spark, d), claims(spark, d))


def sample_budget(spark: SparkSession, d: str) -> DataFrame:
    """The sample's figures, with what each stratum took."""
    taken, figures = inventory.budgeted_sample(fields(spark, d), claims(spark, d))
    return taken.groupBy("stratum").agg(F.count("*").alias("taken")).crossJoin(figures)  # figures: one row


def sample_profiles(spark: SparkSession, d: str) -> DataFrame:
    f, c = fields(spark, d), claims(spark, d)
    ids = inventory.claimed(c)
    taken, _ = inventory.budgeted_sample(f, c, ids=ids)
    return inventory.sampled_profiles(profiles(spark, d), c, f, taken, ids)


def account_constraints(spark: SparkSession, d: str) -> DataFrame:
    return ingest.accounts(profiles(spark, d))


def _aliases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Aliases of most fields, and the plots that are there."""
    f = fields(spark, d)
    v2 = F.concat(F.lit("v2-"), F.col("k").cast("string"))
    return f.filter("k % 6 <> 0").select("v1_geo_id", v2.alias("geo_id")), f.filter("k % 9 <> 0").select(v2.alias("geo_id"))


def assoc_join_report(spark: SparkSession, d: str) -> DataFrame:
    a, plots = _aliases(spark, d)
    return ingest.associations(claims(spark, d), a, plots).groupBy("status").agg(F.count("*").alias("claims"), F.countDistinct("source_key").alias("profiles"))


def fieldlist_roots(spark: SparkSession, d: str) -> DataFrame:
    a, plots = _aliases(spark, d)
    return ingest.field_lists(ingest.associations(claims(spark, d), a, plots))


def import_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as fields to import, and the aliases that an earlier run wrote."""
    k = F.col("p_partkey")
    error = F.when(k % 19 == 0, "no_geometry").when(k % 23 == 0, "unusable: polygon is empty: 12")
    rows = read(spark, d, "part").select(named("P", k).alias("v1_geo_id"), k.alias("position"), error.alias("error"), F.sha2((k - k % 2).cast("string"), 256).alias("content_hash"), F.concat(F.lit("v2-"), k.cast("string")).alias("geo_id"))
    return rows, rows.filter("position % 10 = 7").select("v1_geo_id", F.concat(F.lit("done-"), F.col("position").cast("string")).alias("geo_id"))


def _import(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, done = import_rows(spark, d)
    return ingest.import_fields(rows, done, resolve.verdicts(_scored(spark, d))), done


def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.report(_import(spark, d)[0])


def import_decision(spark: SparkSession, d: str) -> DataFrame:
    """The run's exit code, with the counts that decide it."""
    a, plots = _aliases(spark, d)
    return ingest.exit_code(_import(spark, d)[0], ingest.associations(claims(spark, d), a, plots))


def import_rerun(spark: SparkSession, d: str) -> DataFrame:
    """A second run over what the first one wrote changes nothing."""
    first, done = _import(spark, d)
    written = done.unionByName(ingest.new_aliases(first))
    rows = first.filter("not startswith(outcome, 'quarantined')").select("v1_geo_id", F.lit(0).cast("long").alias("position"), F.lit(None).cast("string").alias("error"), "v1_geo_id", F.col("target").alias("geo_id"))
    rows = rows.toDF("v1_geo_id", "position", "error", "content_hash", "geo_id")
    none = resolve.verdicts(_scored(spark, d)).limit(0)
    return ingest.report(ingest.import_fields(rows, written, none)).select("outcome", "fields")


def resumable_fields(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as fields with their covers; fields of one cover have one hash, some hashes are missing, some fields are broken."""
    k = F.col("p_partkey")
    error = F.when(k % 19 == 0, "no_geometry").when(k % 23 == 0, "unusable: polygon is empty: 12")
    form = F.when(k % 5 == 4, "inner").otherwise((F.col("p_size") % 4).cast("string"))
    digest = F.when(k % 7 != 3, F.sha2(F.concat_ws("/", (k - k % 5).cast("string"), form), 256))
    geo = lambda c: F.concat(F.lit("v2-"), c)
    rows = read(spark, d, "part").select(named("P", k).alias("v1_geo_id"), k.alias("position"), error.alias("error"), digest.alias("content_hash"), geo(named("P", k)).alias("geo_id"))
    return rows, lenses.covers(spark, d).select(geo(F.col("owner")).alias("geo_id"), "cell")


def import_resume(spark: SparkSession, d: str) -> DataFrame:
    """An import into an empty registry that breaks off in the middle and is resumed: every field's outcome is that of an uninterrupted one."""
    rows, covers = resumable_fields(spark, d)
    half = rows.agg(F.floor(F.max("position") / 2)).first()[0] or 0
    held = standing.registry(spark, f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}")
    standing.import_batch(held, "first", rows.filter(F.col("position") <= half), covers)
    standing.import_batch(held, "second", rows, covers)
    # The broken fields of the first half are refused twice.
    return held.read("outcomes").filter("outcome <> 'skipped_already_done'").select("v1_geo_id", "outcome", "target", "parent").distinct()


def alias_upsert(spark: SparkSession, d: str) -> DataFrame:
    existing, _ = _aliases(spark, d)
    wanted = fields(spark, d).select("v1_geo_id", F.when(F.col("k") % 7 == 0, "elsewhere").otherwise(F.concat(F.lit("v2-"), F.col("k").cast("string"))).alias("geo_id"), F.col("k").alias("position"))
    # Every fifth field is wanted under a second target in the same batch.
    wanted = wanted.unionByName(wanted.filter("position % 5 = 0").select("v1_geo_id", F.lit("second").alias("geo_id"), (F.col("position") + 1).alias("position")))
    return ingest.alias_upsert(wanted, existing).groupBy("outcome").agg(F.count("*").alias("aliases"))


def uniqueness_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(k.alias("row"), F.concat(F.lit("g"), (k - F.when(k % 10 == 3, 1).otherwise(0)).cast("string")).alias("geo_id"), F.concat(F.lit("s"), (k - F.when(k % 10 == 5, 1).otherwise(0)).cast("string")).alias("geo_id_short"), F.concat(F.lit("h"), (k - k % 10).cast("string")).alias("content_hash"))
    return ingest.uniqueness(rows)


def quarantine_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("bad ring: at "), k.cast("string"))).when(k % 3 == 1, F.repeat(F.lit("long "), 20)).otherwise("zero area")
    return read(spark, d, "part").select(ingest.reason_of(text).alias("reason")).groupBy("reason").agg(F.count("*").alias("fields"))


def legacy_json_decode(spark: SparkSession, d: str) -> DataFrame:
    """JSON columns, every third one encoded twice."""
    e = read(spark, d, "events")
    twice = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("props").alias("s")))).otherwise(F.col("props"))
    inner = F.coalesce(F.get_json_object(twice, "$.s"), twice)
    return e.select("event_id", F.from_json(inner, "k long")["k"].alias("k"))


_NOW = 1_700_000_000
_VCT, _AUTHORITY = "example.org/grant", "example.org/authority"


def _token(payload) -> object:
    header = credentials.to_base64url(F.lit('{"alg":"EdDSA"}').cast("binary"))
    return F.concat_ws(".", header, credentials.to_base64url(payload.cast("binary")), F.lit("c2ln"))


def _status_lists(spark: SparkSession) -> DataFrame:
    """Three lists of 64 bytes, each written in another way."""
    packed = [base64.urlsafe_b64encode(zlib.compress(bytes((i * 37 + n) % 256 for i in range(64)))).rstrip(b"=").decode() for n in range(3)]
    inside = base64.urlsafe_b64encode(('{"vc":{"credentialSubject":{"status_list":{"lst":"%s"}}}}' % packed[1]).encode()).rstrip(b"=").decode()
    rows = [("L0", '{"encoded":"%s"}' % packed[0]), ("L1", f"aGVhZA.{inside}.c2ln"), ("L2", packed[2] + "\n"), ("L3", "broken")]
    return credentials.status_lists(spark.createDataFrame(rows, "list_id string, body string"))


def grant_checks(spark: SparkSession, d: str) -> DataFrame:
    """Events as grants with every kind of fault."""
    e, k = read(spark, d, "events"), F.col("event_id")
    geo = F.concat(F.lit("g"), k.cast("string"))
    disclosure = credentials.to_base64url(F.to_json(F.array(F.lit("salt"), F.lit("fields.0"), geo)).cast("binary"))
    digest = credentials.to_base64url(F.unhex(F.sha2(F.when(k % 17 == 5, F.concat(disclosure, F.lit("x"))).otherwise(disclosure), 256)))
    payload = F.to_json(F.struct(
        F.when(k % 13 != 0, F.lit(_NOW) + F.when(k % 7 == 0, -1).otherwise(10)).alias("exp"), (F.lit(_NOW) + F.when(k % 11 == 0, 301).otherwise(300)).alias("iat"), F.when(k % 19 == 0, "other").otherwise(_VCT).alias("vct"),
        F.concat(F.lit("list-"), (k % 3).cast("string")).alias("sub"), F.array(digest).alias("_sd"), F.when(k % 5 != 0, F.concat(F.lit("L"), (k % 4).cast("string"))).alias("status_list"), F.when(k % 5 != 0, k % 600).alias("status_index"),
    ))
    rows = e.select(
        F.col("event_id").alias("id"), F.concat(_token(payload), F.lit("~"), disclosure, F.lit("~")).alias("credential"), (k % 23 != 0).alias("signed"),
        F.when(k % 2 == 0, F.when(k % 29 == 0, "elsewhere").otherwise(geo)).alias("geo_id"), F.when(k % 6 == 1, F.lit("list-1")).alias("list_id"),
    )
    return credentials.check_grants(rows, _status_lists(spark), _VCT, _NOW)


def authority_checks(spark: SparkSession, d: str) -> DataFrame:
    e, k = read(spark, d, "events"), F.col("event_id")
    payload = F.to_json(F.struct((F.lit(_NOW) + F.when(k % 7 == 0, -1).otherwise(10)).alias("exp"), F.when(k % 11 == 0, _VCT).otherwise(_AUTHORITY).alias("vct"), F.when(k % 3 == 1, "recall").alias("scope"), F.when(k % 3 == 2, F.array(F.when(k % 2 == 0, "global").otherwise("audit"))).alias("scopes")))
    rows = e.select(F.col("event_id").alias("id"), _token(payload).alias("credential"), F.lit(True).alias("signed"), F.when(k % 5 != 0, F.when(k % 4 == 0, "audit").otherwise("recall")).alias("scope"))
    return credentials.check_authorities(rows, _AUTHORITY, _NOW)


def status_bits(spark: SparkSession, d: str) -> DataFrame:
    lists = _status_lists(spark)
    return lists.crossJoin(spark.range(520).select(F.col("id").alias("i"))).select("list_id", "i", credentials.bit_of(F.col("bits"), F.col("i")).alias("bit"))  # four lists of fixed size


def forward_gates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = read(spark, d, "events").select(k.alias("id"), (k % 2 == 0).alias("capability"), F.when(k % 3 == 0, F.when(k % 5 == 0, "expired").otherwise("ok")).alias("authority"), F.when(k % 7 < 3, F.when(k % 4 == 1, "revoked").otherwise("ok")).alias("grant"), F.when(k % 11 != 0, "recall").alias("scope"))
    return credentials.gate_forward(rows)


def tier_disclosure(spark: SparkSession, d: str) -> DataFrame:
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    matches = o.select(named("O", k).alias("list_id"), F.when(k % 2 == 0, 3).otherwise(1).alias("tier"))
    holders = o.filter("o_orderkey % 5 <> 0").select(named("O", k).alias("list_id"), named("C", F.col("o_custkey")).alias("account"))
    return credentials.with_holders(matches, holders)


QUERIES = {f.__name__: f for f in (
    id_kinds, kind_counts, area_bands, inventory_fields, inventory_profiles, inventory_join_health, orphan_refs, unclaimed_fields, multi_owner, sample_clusters, sample_strata, sample_budget,
    sample_profiles, account_constraints, assoc_join_report, fieldlist_roots, import_outcomes, import_decision, import_rerun, import_resume, alias_upsert, uniqueness_checks, quarantine_reasons, legacy_json_decode,
    grant_checks, authority_checks, status_bits, forward_gates, tier_disclosure,
)}

_FIELDS = """f AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 1 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) WHEN 3 THEN 'x' || p_partkey ELSE h END AS v1_geo_id,
    CASE p_partkey % 4 WHEN 0 THEN 'l13_hash' WHEN 1 THEN 'uuid' WHEN 2 THEN 'l20_hash' ELSE 'unknown' END AS kind, CASE WHEN p_partkey % 5 <> 0 THEN sha256(p_brand || 'l13') END AS l13,
    CASE WHEN p_partkey % 19 = 0 THEN 'none' WHEN p_partkey % 23 = 0 THEN 'bad' WHEN p_partkey % 29 = 0 THEN 'none' ELSE 'point' END AS wkt,
    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 0.0 ELSE p_size * 12.5::DOUBLE / (p_partkey % 7 + 1) END AS area FROM (SELECT *, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part))"""
_PROFILES = """t AS (SELECT 'T' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS source_key, c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'shared@example.com' ELSE 'u' || c_custkey || '@example.com' END AS email,
    CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '+1' || (c_custkey - c_custkey % 3) END AS phone FROM customer)"""
_CLAIMS = """cl AS (SELECT 'T' || lpad(CAST(c AS VARCHAR), 10, '0') AS source_key, c, row_number() OVER (PARTITION BY c ORDER BY k) - 1 AS item, v1_geo_id, known FROM (
    SELECT DISTINCT o_custkey AS c, l_partkey - l_partkey % 3 AS k, v1_geo_id, true AS known FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN f ON f.k = l_partkey - l_partkey % 3
    UNION ALL SELECT c_custkey, 1::BIGINT << 40, 'orphan-' || c_custkey, false FROM customer WHERE c_custkey % 37 = 0))"""
_BAND = "CASE WHEN area IS NULL THEN 'unknown' WHEN area <= 0 THEN 'zero' WHEN area < 1 THEN '<1' WHEN area < 5 THEN '1-5' WHEN area < 50 THEN '5-50' WHEN area < 500 THEN '50-500' ELSE '>500' END"
_BASE = f"WITH RECURSIVE {_FIELDS}, {_PROFILES}, {_CLAIMS}"
_CLUSTERS = """keyed AS (SELECT coalesce(l13, v1_geo_id) AS key, v1_geo_id, k FROM f),
    clusters AS (SELECT key, members, coalesce(owners, 0) AS owners, CASE WHEN coalesce(owners, 0) > 1 THEN 'multi_owner_cluster' ELSE 'l13_collision_cluster' END AS stratum
        FROM (SELECT key, count(*) AS members FROM keyed GROUP BY key HAVING count(*) >= 2) LEFT JOIN (SELECT key, count(DISTINCT source_key) AS owners FROM keyed JOIN cl USING (v1_geo_id) GROUP BY key) USING (key))"""
_STRATA = f"""{_CLUSTERS}, every_one AS (
        SELECT stratum, v1_geo_id, start AS x, k AS y FROM clusters JOIN (SELECT key, min(k) AS start FROM keyed GROUP BY key) USING (key) JOIN keyed USING (key)
        UNION ALL SELECT 'uuid_fallback', v1_geo_id, k, 0 FROM f WHERE kind = 'uuid' UNION ALL SELECT 'l20_fallback', v1_geo_id, k, 0 FROM f WHERE kind = 'l20_hash'
        UNION ALL SELECT 'no_geometry', v1_geo_id, k, 0 FROM f WHERE wkt = 'none' UNION ALL SELECT 'unparseable_geometry', v1_geo_id, k, 0 FROM f WHERE wkt = 'bad'
        UNION ALL SELECT 'zero_or_missing_area', v1_geo_id, k, 0 FROM f WHERE area IS NULL OR area <= 0
        UNION ALL SELECT 'profile_with_orphan_ref', v1_geo_id, c, item FROM cl WHERE known AND c IN (SELECT c FROM cl WHERE NOT known)
        UNION ALL SELECT 'unclaimed_field', v1_geo_id, k, 0 FROM f WHERE v1_geo_id NOT IN (SELECT v1_geo_id FROM cl)
        UNION ALL SELECT 'profile_with_many_fields', v1_geo_id, c, item FROM cl WHERE known AND item < 200 AND c IN (SELECT c FROM cl GROUP BY c HAVING count(*) >= 10)
        UNION ALL SELECT 'area_' || {_BAND}, v1_geo_id, k, 0 FROM f),
    once AS (SELECT stratum, v1_geo_id, min((x, y)) AS spot FROM every_one GROUP BY 1, 2),
    placed AS (SELECT stratum, v1_geo_id, CAST(row_number() OVER (PARTITION BY stratum ORDER BY spot, v1_geo_id) AS INTEGER) AS place FROM once QUALIFY place <= 200)"""
_ALIASES = "al AS (SELECT v1_geo_id, 'v2-' || k AS geo_id FROM f WHERE k % 6 <> 0), pl AS (SELECT 'v2-' || k AS geo_id FROM f WHERE k % 9 <> 0), assoc AS (SELECT source_key, v1_geo_id, al.geo_id, CASE WHEN al.geo_id IS NULL THEN 'v1_not_in_alias_table' WHEN pl.geo_id IS NULL THEN 'alias_points_at_missing_geoid' ELSE 'mapped' END AS status FROM cl LEFT JOIN al USING (v1_geo_id) LEFT JOIN pl ON pl.geo_id = al.geo_id)"
from .graph_queries import TREES  # noqa: E402



def _resume_sql() -> str:
    """The uninterrupted import, place by place: all links are inside groups of five fields, so five steps decide all."""
    text = """f AS (SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS id, p_partkey - p_partkey % 5 AS g, p_partkey % 5 AS j, CASE WHEN p_partkey % 19 = 0 THEN 'no_geometry' WHEN p_partkey % 23 = 0 THEN 'unusable' END AS error,
            CASE WHEN p_partkey % 7 <> 3 THEN sha256((p_partkey - p_partkey % 5) || '/' || CASE WHEN p_partkey % 5 = 4 THEN 'inner' ELSE CAST(p_size % 4 AS VARCHAR) END) END AS h FROM part),
        done0 AS (SELECT id, g, h, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS parent FROM f WHERE false)"""
    for j in range(5):
        text += f""", hash{j} AS (SELECT f.id, min(d.target) AS target FROM f JOIN done{j} d ON d.h = f.h AND d.target IS NOT NULL WHERE f.j = {j} GROUP BY f.id),
        pick{j} AS (SELECT p.a AS id, p.relation, p.b FROM passed p JOIN f ON f.id = p.a AND f.j = {j} JOIN done{j} d ON d.id = p.b AND d.outcome = 'new' QUALIFY row_number() OVER (PARTITION BY p.a ORDER BY p.relation <> 'same_as', p.score DESC, p.b) = 1),
        done{j + 1} AS (SELECT * FROM done{j} UNION ALL SELECT f.id, f.g, f.h, CASE WHEN error IS NOT NULL THEN 'quarantined:' || error WHEN s.target IS NOT NULL OR p.relation = 'same_as' THEN 'same_as' ELSE 'new' END,
            CASE WHEN error IS NOT NULL THEN NULL WHEN s.target IS NOT NULL THEN s.target WHEN p.relation = 'same_as' THEN 'v2-' || p.b ELSE 'v2-' || f.id END,
            CASE WHEN error IS NULL AND s.target IS NULL AND p.relation = 'child_of' THEN 'v2-' || p.b END
            FROM f LEFT JOIN hash{j} s USING (id) LEFT JOIN pick{j} p USING (id) WHERE f.j = {j})"""
    return sql(_SCORED_VIEWS, f"{_SCORED}, {text} SELECT id AS v1_geo_id, outcome, target, parent FROM done5")


_SPARK_BITS = "((i // 8 * 37 + n) % 256 >> (i % 8)) & 1"

ORACLE_SQL = {
    "id_kinds": f"{_BASE} SELECT k AS position, kind FROM f",
    "kind_counts": f"{_BASE} SELECT kind, count(*) AS fields FROM f GROUP BY kind",
    "area_bands": f"{_BASE} SELECT {_BAND} AS band, count(*) AS fields FROM f GROUP BY 1",
    "inventory_fields": f"{_BASE} SELECT count(*) AS total_fields, count(*) FILTER (wkt <> 'none') AS with_geometry, count(*) FILTER (wkt = 'point') AS parseable_geometry, count(*) FILTER (wkt = 'point') AS zero_or_invalid_area, count(DISTINCT coalesce(l13, v1_geo_id)) AS distinct_keys, count(*) - count(DISTINCT coalesce(l13, v1_geo_id)) AS collisions FROM f",
    "inventory_profiles": f"""{_BASE}, n AS (SELECT source_key, count(*) AS n FROM cl GROUP BY 1) SELECT count(*) AS total_profiles, count(n) AS profiles_with_fields, coalesce(max(n), 0) AS max_fields, count(*) FILTER (coalesce(email, '') = '') AS missing_email, count(*) FILTER (coalesce(phone, '') = '') AS missing_phone,
        (SELECT count(*) FROM (SELECT email FROM t WHERE email <> '' GROUP BY 1 HAVING count(*) > 1)) AS duplicate_emails, (SELECT count(*) FROM (SELECT phone FROM t WHERE phone <> '' GROUP BY 1 HAVING count(*) > 1)) AS duplicate_phones FROM t LEFT JOIN n USING (source_key)""",
    "inventory_join_health": f"{_BASE} SELECT (SELECT count(*) FROM cl WHERE NOT known) AS orphan_refs, (SELECT count(*) FROM f WHERE v1_geo_id NOT IN (SELECT v1_geo_id FROM cl)) AS unclaimed_fields, (SELECT count(*) FROM (SELECT v1_geo_id FROM cl GROUP BY 1 HAVING count(DISTINCT source_key) > 1)) AS multi_owner_ids",
    "orphan_refs": f"{_BASE} SELECT source_key, v1_geo_id FROM cl WHERE NOT known",
    "unclaimed_fields": f"{_BASE} SELECT v1_geo_id FROM f WHERE v1_geo_id NOT IN (SELECT v1_geo_id FROM cl)",
    "multi_owner": f"{_BASE} SELECT v1_geo_id, CAST(count(DISTINCT source_key) AS INTEGER) AS n_owners, min(source_key) AS first_owner FROM cl GROUP BY 1 HAVING count(DISTINCT source_key) > 1",
    "sample_clusters": f"{_BASE}, {_CLUSTERS} SELECT key, members, owners, stratum FROM clusters",
    "sample_strata": f"{_BASE}, {_STRATA} SELECT stratum, v1_geo_id, place FROM placed",
    "account_constraints": f"""WITH b AS (SELECT 'T' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS source_key, c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'email_not_null' WHEN c_custkey % 31 = 0 OR c_custkey % 37 = 0 THEN 'name_not_null' WHEN c_custkey % 41 = 0 THEN 'client_id_length' END AS broken, c_custkey % 13 = 0 AS shared FROM customer)
        SELECT source_key, coalesce(broken, CASE WHEN shared AND row_number() OVER (PARTITION BY broken IS NULL AND shared ORDER BY k) > 1 THEN 'email_unique' ELSE 'created' END) AS outcome FROM b""",
    "assoc_join_report": f"{_BASE}, {_ALIASES} SELECT status, count(*) AS claims, count(DISTINCT source_key) AS profiles FROM assoc GROUP BY status",
    "fieldlist_roots": f"{_BASE}, {_ALIASES}, n0 AS (SELECT lot, m, list_transform(m, lambda x: sha256(x)) AS n FROM (SELECT source_key AS lot, list_sort(list(DISTINCT geo_id)) AS m FROM assoc WHERE status = 'mapped' GROUP BY 1)), {TREES} SELECT lot AS source_key, n[1] AS list_id, CAST(len(m) AS BIGINT) AS n_plots FROM tree WHERE len(n) = 1",
    "import_decision": f"""{_BASE}, {_ALIASES} SELECT (SELECT count(*) FROM part WHERE p_partkey % 10 = 7 OR (p_partkey % 19 <> 0 AND p_partkey % 23 <> 0)) AS fine,
        (SELECT count(*) FROM part WHERE p_partkey % 10 <> 7 AND (p_partkey % 19 = 0 OR p_partkey % 23 = 0)) AS quarantined, (SELECT count(*) FROM assoc WHERE status <> 'mapped') AS failed, 1 AS code""",
    "alias_upsert": f"{_BASE} SELECT outcome, count(*) AS aliases FROM (SELECT CASE WHEN k % 6 = 0 THEN 'inserted' WHEN k % 7 = 0 THEN 'refused' ELSE 'unchanged' END AS outcome FROM f UNION ALL SELECT 'refused' FROM f WHERE k % 5 = 0) GROUP BY 1",
    "import_resume": _resume_sql(),
    "uniqueness_checks": "SELECT p_partkey AS row, CASE WHEN p_partkey % 10 = 3 AND EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = part.p_partkey - 1) THEN 'geo_id' WHEN p_partkey % 10 = 5 AND EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = part.p_partkey - 1) THEN 'geo_id_short' WHEN EXISTS (SELECT 1 FROM part b WHERE b.p_partkey < part.p_partkey AND b.p_partkey // 10 = part.p_partkey // 10) THEN 'content_hash' END AS violation FROM part",
    "quarantine_reasons": "SELECT trim(substr(CASE p_partkey % 3 WHEN 0 THEN 'bad ring' WHEN 1 THEN rtrim(repeat('long ', 20)) ELSE 'zero area' END, 1, 60), '') AS reason, count(*) AS fields FROM part GROUP BY 1",
    "legacy_json_decode": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "grant_checks": """WITH e AS (SELECT event_id AS id, event_id AS k FROM events), s AS (SELECT *, k % 600 AS i, k % 4 AS n FROM e)
        SELECT id, CASE WHEN k % 23 = 0 THEN 'bad_signature' WHEN k % 13 = 0 THEN 'no_expiry' WHEN k % 7 = 0 THEN 'expired' WHEN k % 11 = 0 THEN 'issued_in_future' WHEN k % 19 = 0 THEN 'wrong_kind' WHEN k % 17 = 5 THEN 'unknown_disclosure'
            WHEN k % 6 = 1 AND k % 3 <> 1 THEN 'other_list' WHEN k % 2 = 0 AND k % 29 = 0 THEN 'not_disclosed' WHEN k % 5 <> 0 AND (n = 3 OR i >= 512) THEN 'status_unreadable'
            WHEN k % 5 <> 0 AND ((i // 8 * 37 + n) % 256 >> (i % 8)) & 1 = 1 THEN 'revoked' ELSE 'ok' END AS decision FROM s""",
    "authority_checks": """WITH e AS (SELECT event_id AS id, event_id AS k FROM events)
        SELECT id, CASE WHEN k % 7 = 0 THEN 'expired' WHEN k % 11 = 0 THEN 'wrong_kind' WHEN k % 3 = 0 THEN 'no_scope'
            WHEN k % 5 <> 0 AND NOT (CASE WHEN k % 3 = 1 THEN k % 4 <> 0 ELSE k % 2 = 0 OR k % 4 = 0 END) THEN 'out_of_scope' ELSE 'ok' END AS decision FROM e""",
    "status_bits": f"WITH b AS (SELECT unnest([0, 1, 2]) AS n), r AS (SELECT CAST(range AS BIGINT) AS i FROM range(520)) SELECT 'L' || n AS list_id, i, CASE WHEN i < 512 THEN CAST({_SPARK_BITS} AS INTEGER) END AS bit FROM b, r UNION ALL SELECT 'L3', i, NULL FROM r",
    "forward_gates": """WITH r AS (SELECT event_id AS k, event_id % 2 = 0 AS cap, event_id % 3 = 0 AS auth, event_id % 7 < 3 AS gr FROM events),
        s AS (SELECT k, auth, CASE WHEN NOT cap AND NOT gr AND NOT auth THEN 403 WHEN auth AND k % 11 = 0 THEN 400 WHEN auth AND k % 5 = 0 THEN 401 WHEN NOT auth AND gr AND k % 4 = 1 THEN 403 ELSE 200 END AS status FROM r)
        SELECT k AS id, status, CASE WHEN status = 200 THEN CASE WHEN auth THEN 3 ELSE 1 END END AS tier FROM s""",
    "tier_disclosure": "SELECT 'O' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS list_id, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END AS tier, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'C' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS holder, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 <> 0 THEN 'resolved' ELSE 'unresolved' END END AS holder_status FROM orders",
}
