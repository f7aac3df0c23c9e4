"""Queries over access to plots, progress of uploads, and imports that write nothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ed25519
from ..functions.lineage import spread
from ..operators import credentials, ingest, registry, resolve
from ..sources import readers, sinks
from . import lenses, pipeline_queries
from .lenses import named, read


def artifact_access(spark: SparkSession, d: str) -> DataFrame:
    """Events as read requests with every mix of secret, authority and grant."""
    k = F.col("event_id")
    rows = read(spark, d, "events").select(
        k.alias("id"), (k % 31 == 0).alias("internal"), F.when(k % 3 == 0, F.when(k % 5 == 0, "expired").otherwise("ok")).alias("authority"),
        F.when(k % 7 < 4, F.when(k % 4 == 1, "revoked").otherwise("ok")).alias("grant"), F.when(k % 6 != 5, k % 2 == 0).alias("conceal"),
    )
    return credentials.authorise(rows)


def full_view(spark: SparkSession, d: str) -> DataFrame:
    """Parts as plots seen by readers with a grant, with an account only, and with neither."""
    k = F.col("p_partkey")
    x, y = (k % 100).cast("double"), (k % 50).cast("double")
    pairs = ((x, y), (x + 0.5, y), (x + 0.5, y + 0.5), (x, y))
    ring = F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in pairs])
    wkt = F.when(k % 4 == 0, F.concat(F.lit("MULTIPOLYGON((("), ring, F.lit(")), (("), ring, F.lit(")))"))).when(k % 4 == 1, F.concat(F.lit("POLYGON(("), ring, F.lit("))")))
    wkt = wkt.when(k % 4 == 2, F.concat(F.lit("LINESTRING("), ring, F.lit(")"))).otherwise(F.concat(F.lit("POINT ("), F.concat_ws(" ", (x + 0.5).cast("string"), (y + 0.5).cast("string")), F.lit(")")))
    levels = F.create_map(F.lit("8"), F.lit("a"), F.lit("13"), k.cast("string"), F.lit("wkt"), wkt, F.lit("regime"), F.lit("v2"))
    plots = read(spark, d, "part").select(named("P", k).alias("geo_id"), wkt.alias("wkt"), levels.alias("levels"), F.when(k % 5 != 4, k % 5 < 2).alias("granted"), (k % 3 == 0).alias("account"))
    seen = registry.full_view(plots, [13, 20], accounts=True)
    kind = F.get_json_object("geo_json", "$.type")
    # The third corner, or the point itself.
    third = F.when(kind == "Polygon", F.get_json_object("geo_json", "$.coordinates[0][2]")).when(kind == "MultiPolygon", F.get_json_object("geo_json", "$.coordinates[0][0][2]")).when(kind == "LineString", F.get_json_object("geo_json", "$.coordinates[2]")).otherwise(F.get_json_object("geo_json", "$.coordinates"))
    at = F.from_json(third, "array<double>")
    return seen.select("geo_id", "tier", kind.alias("kind"), at[0].alias("lng"), at[1].alias("lat"), F.array_join(F.array_sort(F.map_keys("levels")), ",").alias("keys"), F.col("levels")["13"].alias("l13"))


SEEDS = [bytes([n]) * 32 for n in range(4)]


@F.pandas_udf(T.BinaryType())
def _signed(key: pd.Series, message: pd.Series) -> pd.Series:
    return pd.Series([ed25519.sign(SEEDS[k], bytes(m)) for k, m in zip(key, message)])


def grant_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Customers' grants, signed by four issuers; some are changed, cut short, signed by another, or name no known key or algorithm."""
    k = F.col("c_custkey")
    keys = spark.createDataFrame([(f"key-{n}", ed25519.public_key(seed)) for n, seed in enumerate(SEEDS)], "kid string, public binary")
    header = F.to_json(F.struct(F.when(k % 41 == 0, "none").otherwise("EdDSA").alias("alg"), F.concat(F.lit("key-"), F.when(k % 29 == 0, 9).otherwise(k % 4).cast("string")).alias("kid")))
    payload = F.to_json(F.struct(F.lit(2_000_000_000).alias("exp"), k.cast("string").alias("sub")))
    part = lambda c: credentials.to_base64url(c.cast("binary"))
    customers = spread(read(spark, d, "customer").select("c_custkey"), credentials.SIGNATURES)
    rows = customers.select(k.alias("id"), F.concat_ws(".", part(header), part(payload)).alias("message"))
    other = F.when(F.col("id") % 31 == 0, (F.col("id") + 1) % 4).otherwise(F.col("id") % 4).cast("int")
    rows = rows.withColumn("signature", _signed(other, F.col("message").cast("binary")))
    # The first byte's low half changed, or the last byte gone.
    bits = F.hex("signature")
    flipped = F.unhex(F.concat(F.when(F.substring(bits, 2, 1) == "0", F.concat(F.substring(bits, 1, 1), F.lit("1"))).otherwise(F.concat(F.substring(bits, 1, 1), F.lit("0"))), F.substring(bits, 3, 126)))
    signature = F.when(F.col("id") % 23 == 0, flipped).when(F.col("id") % 37 == 0, F.unhex(F.substring(bits, 1, 126))).otherwise(F.col("signature"))
    tokens = rows.select("id", F.concat(F.col("message"), F.lit("."), credentials.to_base64url(signature), F.lit("~")).alias("credential"))
    return credentials.with_signatures(tokens, keys).select("id", "signed")


def boundary_filter(spark: SparkSession, d: str) -> DataFrame:
    """Plots at the customers' own coordinates, with and without a boundary type."""
    from ..functions import cells

    p = lenses.points(spark, d)
    leaf = cells.from_lat_lng(F.col("lat"), F.col("lng"))
    kind = F.when(F.col("k") % 3 != 2, F.when(F.col("k") % 3 == 0, "manual").otherwise("automated"))
    listed = p.select("geo_id", kind.alias("boundary_type"), F.explode(F.array(*[cells.parent(leaf, n) for n in (13, 20)])).alias("cell"))
    probes = p.select(F.col("geo_id").alias("probe"), "lat", "lng")
    found = registry.at_coordinate(probes, listed).withColumn("asked", F.lit("any")).unionByName(registry.at_coordinate(probes, listed, "manual").withColumn("asked", F.lit("manual")))
    return found.filter("probe = geo_id").select("asked", "geo_id")


def token_flattening(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    index = F.concat(F.lit('{"13": ["a'), k, F.lit('", "b'), k, F.lit('"], "20": '), F.when(F.col("p_partkey") % 3 == 0, F.lit("[]")).when(F.col("p_partkey") % 3 == 1, F.lit("null")).otherwise(F.concat(F.lit('["b'), k, F.lit('", "c"]'))), F.lit(', "regime": "v2", "levels": 2}'))
    return read(spark, d, "part").select(named("P", F.col("p_partkey")).alias("geo_id"), F.array_join(F.array_sort(registry.flat_tokens(index)), ",").alias("tokens"))


def progress_lines(spark: SparkSession, d: str) -> DataFrame:
    """An upload of all parts, as the lines its client reads."""
    rows = read(spark, d, "part").select((F.col("p_partkey") - 1).alias("row"), F.when(F.col("p_partkey") % 4 == 0, "exists").otherwise("created").alias("outcome"))
    total = rows.count()
    at = lambda path: F.get_json_object("line", path)
    return sinks.progress_lines(rows, total, 1.5).select("seq", at("$.status").alias("status"), at("$.total").cast("long").alias("total"), at("$.percentage").cast("double").alias("percentage"), at("$.outcome").alias("outcome"), at("$.results.exists").cast("long").alias("existing"))


def holder_failures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    matches = read(spark, d, "orders").select(named("C", F.col("o_custkey")).alias("request"), named("O", k).alias("list_id"), F.when(F.col("o_custkey") % 2 == 0, 3).otherwise(1).alias("tier"), F.when(F.col("o_custkey") % 2 == 0, named("H", k % 50)).alias("holder"))
    failed = read(spark, d, "customer").filter("c_custkey % 5 = 0").select(named("C", F.col("c_custkey")).alias("request"))
    return credentials.with_failures(matches, failed)


def import_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """The same import as ``import_outcomes`` with nothing written."""
    rows, done = pipeline_queries.import_rows(spark, d)
    return ingest.run(rows, done, resolve.verdicts(pipeline_queries._scored(spark, d)), "", dry_run=True).select("outcome", "fields", "nested")


def sampled_source(spark: SparkSession, d: str) -> DataFrame:
    """Fields and profiles of a sample; the inventory beside it stays that of the whole source."""
    fields = read(spark, d, "part").select(named("P", F.col("p_partkey")).alias("v1_geo_id"), F.col("p_size").alias("size"))
    profiles = read(spark, d, "customer").select(named("C", F.col("c_custkey")).alias("source_key"), F.col("c_nationkey").alias("nation"))
    chosen = fields.filter("size <= 10").select("v1_geo_id").unionByName(fields.filter("size <= 5").select("v1_geo_id"))
    some, few = readers.sampled(fields, profiles, chosen, profiles.filter("nation < 5").select("source_key"))
    n = lambda df, name: df.agg(F.count("*").alias("rows"), F.countDistinct(df.columns[0]).alias("ids")).select(F.lit(name).alias("source"), "rows", "ids")
    return n(some, "sampled fields").unionByName(n(few, "sampled profiles")).unionByName(n(fields, "fields")).unionByName(n(profiles, "profiles"))


QUERIES = {f.__name__: f for f in (artifact_access, full_view, grant_signatures, boundary_filter, token_flattening, progress_lines, holder_failures, import_dry_run, sampled_source)}

_ID = "lpad(CAST({} AS VARCHAR), 10, '0')"
_P, _C, _O = "'P' || " + _ID.format("p_partkey"), "'C' || " + _ID.format("c_custkey"), "'O' || " + _ID.format("o_orderkey")
ORACLE_SQL = {
    "artifact_access": """WITH r AS (SELECT event_id AS k, event_id % 31 = 0 AS internal, event_id % 3 = 0 AS shown, event_id % 3 = 0 AND event_id % 5 <> 0 AS good, event_id % 7 < 4 AND event_id % 4 <> 1 AS granted,
            event_id % 6 = 5 OR event_id % 2 = 0 AS hidden FROM events)
        SELECT k AS id, CASE WHEN internal OR good THEN 200 WHEN shown AND NOT hidden THEN 401 WHEN granted THEN 200 WHEN hidden THEN 404 ELSE 403 END AS status, good AND NOT internal AS used_authority FROM r""",
    "full_view": f"""WITH r AS (SELECT p_partkey AS k, {_P} AS geo_id, p_partkey % 5 < 2 OR p_partkey % 3 = 0 AS may FROM part)
        SELECT geo_id, CASE WHEN may THEN 'L1' ELSE 'L0' END AS tier, CASE WHEN may THEN CASE k % 4 WHEN 0 THEN 'MultiPolygon' WHEN 1 THEN 'Polygon' WHEN 2 THEN 'LineString' ELSE 'Point' END END AS kind,
            CASE WHEN may THEN k % 100 + 0.5::DOUBLE END AS lng, CASE WHEN may THEN k % 50 + 0.5::DOUBLE END AS lat, CASE WHEN may THEN '13,regime' END AS keys, CASE WHEN may THEN CAST(k AS VARCHAR) END AS l13 FROM r""",
    "grant_signatures": "SELECT c_custkey AS id, c_custkey % 23 <> 0 AND c_custkey % 29 <> 0 AND c_custkey % 31 <> 0 AND c_custkey % 37 <> 0 AND c_custkey % 41 <> 0 AS signed FROM customer",
    "boundary_filter": f"SELECT 'any' AS asked, {_C} AS geo_id FROM customer UNION ALL SELECT 'manual', {_C} FROM customer WHERE c_custkey % 3 = 0",
    "token_flattening": f"SELECT {_P} AS geo_id, CASE WHEN p_partkey % 3 = 2 THEN 'a' || p_partkey || ',b' || p_partkey || ',c' ELSE 'a' || p_partkey || ',b' || p_partkey END AS tokens FROM part",
    "progress_lines": """WITH n AS (SELECT count(*) AS total, count(*) FILTER (p_partkey % 4 = 0) AS existing FROM part)
        SELECT CAST(0 AS BIGINT) AS seq, 'started' AS status, total, NULL::DOUBLE AS percentage, NULL AS outcome, NULL::BIGINT AS existing FROM n
        UNION ALL SELECT p_partkey, 'processing', total, round(100.0::DOUBLE * p_partkey / total, 2), CASE WHEN p_partkey % 4 = 0 THEN 'exists' ELSE 'created' END, NULL FROM part, n
        UNION ALL SELECT total + 1, 'completed', total, NULL, NULL, existing FROM n""",
    "holder_failures": f"""WITH r AS (SELECT 'C' || {_ID.format("o_custkey")} AS request, {_O} AS list_id, o_custkey % 2 = 0 AS open, o_custkey % 10 = 0 AS failed, 'H' || {_ID.format("o_orderkey % 50")} AS h FROM orders)
        SELECT request, list_id, CASE WHEN open THEN 3 ELSE 1 END AS tier, CASE WHEN open AND NOT failed THEN h END AS holder, CASE WHEN failed THEN 502 ELSE 200 END AS status FROM r""",
    "import_dry_run": """SELECT CASE WHEN p_partkey % 10 = 7 THEN 'skipped_already_done' WHEN p_partkey % 19 = 0 THEN 'quarantined:no_geometry' WHEN p_partkey % 23 = 0 THEN 'quarantined:unusable' ELSE 'new' END AS outcome,
        count(*) AS fields, CAST(0 AS BIGINT) AS nested FROM part GROUP BY 1""",
    "sampled_source": """SELECT 'sampled fields' AS source, count(*) AS rows, count(*) AS ids FROM part WHERE p_size <= 10 UNION ALL SELECT 'sampled profiles', count(*), count(*) FROM customer WHERE c_nationkey < 5
        UNION ALL SELECT 'fields', count(*), count(*) FROM part UNION ALL SELECT 'profiles', count(*), count(*) FROM customer""",
}
