"""Queries over the lot graph."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import lots, trace
from . import lenses
from .lenses import named, read, sql


def _seeds(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """What is recalled: all plots of one brand, or all plots."""
    return read(spark, d, "part").filter(F.lit(True) if whole else "p_brand = 'Brand#11'").select(named("P", F.col("p_partkey")).alias("seed"))


def _forward(spark: SparkSession, d: str, whole: bool = False) -> trace.TraceForward:
    return trace.TraceForward(
        _seeds(spark, d, whole), lenses.members(spark, d, True), lenses.list_parents(spark, d), lenses.aliases(spark, d),
        lenses.covers(spark, d), lenses.region_cells(spark, d), lenses.region_parents(spark, d),
    )


def trace_forward(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _forward(spark, d, whole).lots


def trace_forward_direct(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return trace.trace_forward(_seeds(spark, d, whole), lenses.members(spark, d, True), lenses.list_parents(spark, d))


def trace_forward_labels(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _forward(spark, d, whole).labels


def _back(spark: SparkSession, d: str, depth: int = 64, roots: DataFrame | None = None, whole: bool = False) -> trace.TraceBack:
    if roots is None:
        roots = read(spark, d, "customer").filter(F.lit(True) if whole else "c_mktsegment = 'BUILDING'").select(named("C", F.col("c_custkey")).alias("root"))
    return trace.TraceBack(roots, lenses.members(spark, d), lenses.list_parents(spark, d), lenses.artifacts(spark, d), lenses.region_parents(spark, d), depth)


def trace_back_hops(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _back(spark, d, whole=whole).hops


def trace_back_edges(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _back(spark, d, whole=whole).edges


def trace_back_closure(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _back(spark, d, whole=whole).closure


def trace_back_missing_locations(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _back(spark, d, whole=whole).missing_locations


def trace_back_summary(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return _back(spark, d, whole=whole).summary


def trace_back_truncated(spark: SparkSession, d: str) -> DataFrame:
    roots = read(spark, d, "region").select(named("R", F.col("r_regionkey")).alias("root"))
    return _back(spark, d, 3, roots).summary.select("root", "hops", "max_depth", "truncated")


def equivalence_set(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return trace.equivalence_set(_seeds(spark, d, whole), lenses.aliases(spark, d))


def reverse_lookup(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return trace.reverse_lookup(_seeds(spark, d, whole), lenses.members(spark, d), lenses.aliases(spark, d))


def region_ancestor_probe(spark: SparkSession, d: str) -> DataFrame:
    found = trace.ancestor_probe(lenses.covers(spark, d), lenses.region_cells(spark, d))
    # Lists are counted before they meet the owners, whose rows each list would repeat.
    lists = lenses.region_parents(spark, d).groupBy("region_id").agg(F.count("list_id").alias("lists"))
    return found.join(lists, "region_id", "left").select("owner", "region_id", F.coalesce("lists", F.lit(0)).alias("lists"))


def region_member_plots(spark: SparkSession, d: str) -> DataFrame:
    roots = read(spark, d, "nation").select(named("N", F.col("n_nationkey")).alias("seed"))
    plots = trace.region_members(roots.withColumn("node", F.col("seed")), lenses.members(spark, d), lenses.list_parents(spark, d))
    return plots.groupBy("seed").agg(F.count("*").alias("plots"), F.min("geoid").alias("first_plot"), F.max("geoid").alias("last_plot"))


def list_members(spark: SparkSession, d: str) -> DataFrame:
    return trace.list_members(lenses.members(spark, d), lenses.list_parents(spark, d), lenses.region_parents(spark, d))


def member_kind_split(spark: SparkSession, d: str) -> DataFrame:
    return trace.split_members(list_members(spark, d))


def _lot_members(spark: SparkSession, d: str) -> DataFrame:
    return lenses.members(spark, d).select(F.col("list_id").alias("lot"), F.col("geoid").alias("member"))


def merkle_root_orders(spark: SparkSession, d: str) -> DataFrame:
    return lots.lot_roots(_lot_members(spark, d))


def merkle_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Every member's proof leads to its lot's root; the sibling of the leaf is the first step."""
    rows = lots.lot_proofs(_lot_members(spark, d))
    return rows.select("lot", "member", F.size("proof").alias("steps"), F.get("proof", F.lit(0))["sibling"].alias("first_sibling"), "verified")


def lot_registration(spark: SparkSession, d: str) -> DataFrame:
    wanted = _lot_members(spark, d)
    known = lots.lot_roots(wanted.filter(F.substring("lot", -1, 1) == "3")).select("list_id")
    return lots.register_lots(wanted, known)[0]


def cover_identity(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import cells

    t = lenses.covers(spark, d).groupBy("owner").agg(F.collect_set(cells.id_to_token(F.col("cell"))).alias("t"))
    identity = digests.cover_digest(F.col("t"))
    return t.select("owner", identity.alias("geo_id"), digests.short_id(identity).alias("geo_id_short"), digests.region_digest(F.col("t")).alias("region_id"))


def region_normalise(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import cells

    return cells.normalise(lenses.covers(spark, d)).select("owner", cells.id_to_token(F.col("cell")).alias("token"))


def region_registration(spark: SparkSession, d: str) -> DataFrame:
    return lots.register_regions(lenses.covers(spark, d))


QUERIES = {f.__name__: f for f in (
    trace_forward, trace_forward_direct, trace_forward_labels, trace_back_hops, trace_back_edges, trace_back_closure, trace_back_missing_locations, trace_back_summary,
    trace_back_truncated, equivalence_set, reverse_lookup, region_ancestor_probe, region_member_plots, list_members, member_kind_split, merkle_root_orders, merkle_proofs,
    lot_registration, cover_identity, region_normalise, region_registration,
)}
#: Queries about one brand's plots or one segment's customers; as ``NAME_all`` they are about every plot or customer.
SEEDED = (
    trace_forward, trace_forward_direct, trace_forward_labels, equivalence_set, reverse_lookup,
    trace_back_hops, trace_back_edges, trace_back_closure, trace_back_missing_locations, trace_back_summary,
)
QUERIES |= {f"{f.__name__}_all": partial(f, whole=True) for f in SEEDED}

_SEEDS = "seeds AS (SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS seed FROM part WHERE p_brand = 'Brand#11')"
_EQUAL = f"""{_SEEDS}, eq AS (
    SELECT seed, seed AS node FROM seeds
    UNION SELECT seed, canonical FROM seeds JOIN aliases ON seed = alias AND relation = 'same_as'
    UNION SELECT seed, alias FROM seeds JOIN aliases ON seed = canonical AND relation = 'same_as')"""
_FORWARD = f"""{_EQUAL}, start AS (
    SELECT seed, list_id AS node, 0 AS rank FROM eq JOIN members ON node = geoid
    UNION SELECT seed, rp.list_id, 1 FROM eq JOIN ancestors a ON a.owner = eq.node JOIN region_cells rc ON rc.cell = a.up JOIN region_parents rp USING (region_id)
), up AS (SELECT seed, node, 0 AS depth FROM start UNION SELECT seed, parent, depth + 1 FROM up JOIN list_parents ON node = child),
found AS (
    SELECT seed, node AS list_id, CASE WHEN EXISTS (SELECT 1 FROM start s WHERE s.seed = up.seed AND s.node = up.node AND s.rank = 0) THEN 'match' ELSE 'contained' END AS resolution, CAST(min(depth) AS INTEGER) AS depth
    FROM up GROUP BY seed, node)"""
_FORWARD_VIEWS = "members list_parents aliases places covers region_cells region_parents ancestors"
_BACK_VIEWS = "members list_parents artifacts region_parents"


def _back_sql(cap: int = 64, roots: str = "SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS root FROM customer WHERE c_mktsegment = 'BUILDING'") -> str:
    return f"""down AS (
        SELECT root, root AS list_id, 0 AS depth FROM ({roots})
        UNION SELECT root, child, depth + 1 FROM down JOIN list_parents ON list_id = parent WHERE depth < {cap - 1}),
    visited AS (SELECT root, list_id, CAST(min(depth) AS INTEGER) AS depth FROM down GROUP BY root, list_id),
    below AS (SELECT DISTINCT list_id, geoid AS child, 'geoid' AS kind FROM members UNION SELECT parent, child, 'list' FROM list_parents UNION SELECT list_id, region_id, 'region' FROM region_parents),
    edges AS (SELECT root, list_id, child, kind FROM visited JOIN below USING (list_id)),
    hops AS (
        SELECT v.root, v.list_id, v.depth, a.event_type, a.location, a.location IS NOT NULL AS location_recorded,
            coalesce(list_sort(list(DISTINCT e.child) FILTER (e.kind = 'geoid')), []) AS geoids, coalesce(list_sort(list(DISTINCT e.child) FILTER (e.kind = 'list')), []) AS input_list_ids,
            coalesce(list_sort(list(DISTINCT e.child) FILTER (e.kind = 'region')), []) AS input_region_ids
        FROM visited v LEFT JOIN edges e ON e.root = v.root AND e.list_id = v.list_id LEFT JOIN artifacts a ON a.list_id = v.list_id
        GROUP BY v.root, v.list_id, v.depth, a.event_type, a.location)"""


_SUMMARY = """SELECT root, count(*) AS hops, max(depth) AS max_depth, count(location) AS locations, max(len(input_region_ids) > 0) AS regions_unexpanded, false AS truncated FROM hops GROUP BY root"""
_LEAVES = """n0 AS (SELECT lot, m, list_transform(m, lambda x: sha256(x)) AS n FROM (SELECT list_id AS lot, list_sort(list(DISTINCT geoid)) AS m FROM members GROUP BY 1))"""
#: All levels of the trees over n0, the leaves first.
TREES = """tree AS (SELECT lot, m, n, 0 AS height FROM n0
    UNION ALL SELECT lot, m, list_transform(range(0, (len(n) + 1) // 2), lambda k: CASE WHEN 2 * k + 2 <= len(n) THEN sha256(unhex(n[2 * k + 1]) || unhex(n[2 * k + 2])) ELSE n[2 * k + 1] END), height + 1 FROM tree WHERE len(n) > 1)"""
_ROOTS = f"{_LEAVES}, {TREES}, roots AS (SELECT lot, CAST(len(m) AS BIGINT) AS n_members, n[1] AS list_id FROM tree WHERE len(n) = 1)"
_TOKEN = "rtrim(lpad(format('{:x}', cell), 16, '0'), '0')"
_NORMAL = f"""base AS (SELECT DISTINCT c.owner, c.cell FROM covers c WHERE NOT EXISTS (SELECT 1 FROM covers b JOIN ancestors a ON a.owner = c.owner AND a.cell = c.cell AND a.up = b.cell WHERE b.owner = c.owner AND b.cell <> c.cell)),
    full4 AS (SELECT owner, (cell & -((cell & -cell) * 4)) | ((cell & -cell) * 4) AS up FROM base GROUP BY 1, 2 HAVING count(*) = 4),
    normal AS (
        SELECT owner, cell FROM base WHERE NOT EXISTS (SELECT 1 FROM full4 f WHERE f.owner = base.owner AND f.up = ((base.cell & -((base.cell & -base.cell) * 4)) | ((base.cell & -base.cell) * 4)))
        UNION ALL SELECT owner, up FROM full4),
    tokens AS (SELECT owner, {_TOKEN} AS token FROM normal)"""

ORACLE_SQL = {
    "trace_forward": sql(_FORWARD_VIEWS, f"{_FORWARD} SELECT seed, list_id, resolution, depth FROM found"),
    "trace_forward_direct": sql("members list_parents", f"""{_SEEDS}, start AS (SELECT seed, list_id AS node FROM seeds JOIN members ON seed = geoid),
        up AS (SELECT seed, node, 0 AS depth FROM start UNION SELECT seed, parent, depth + 1 FROM up JOIN list_parents ON node = child)
        SELECT seed, node AS list_id, CASE WHEN min(depth) = 0 THEN 'match' ELSE 'contained' END AS resolution, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY 1, 2"""),
    "trace_forward_labels": sql(_FORWARD_VIEWS, f"{_FORWARD} SELECT seed, resolution, count(*) AS lots FROM found GROUP BY 1, 2"),
    "trace_back_hops": sql(_BACK_VIEWS, f"{_back_sql()} SELECT * FROM hops"),
    "trace_back_edges": sql(_BACK_VIEWS, f"{_back_sql()} SELECT * FROM edges"),
    "trace_back_closure": sql(_BACK_VIEWS, f"{_back_sql()} SELECT DISTINCT root, child AS geoid FROM edges WHERE kind = 'geoid'"),
    "trace_back_missing_locations": sql(_BACK_VIEWS, f"{_back_sql()} SELECT root, list_id, depth FROM hops WHERE NOT location_recorded"),
    "trace_back_summary": sql(_BACK_VIEWS, f"{_back_sql()} {_SUMMARY}"),
    "trace_back_truncated": sql(_BACK_VIEWS, _back_sql(3, "SELECT 'R' || lpad(CAST(r_regionkey AS VARCHAR), 10, '0') AS root FROM region") + """
        SELECT root, count(*) AS hops, max(depth) AS max_depth, EXISTS (SELECT 1 FROM visited v JOIN list_parents p ON v.list_id = p.parent WHERE v.root = hops.root AND v.depth = 2) AS truncated FROM hops GROUP BY root"""),
    "equivalence_set": sql("aliases", f"{_EQUAL} SELECT seed, node FROM eq"),
    "reverse_lookup": sql("aliases members", f"{_EQUAL} SELECT DISTINCT seed, list_id FROM eq JOIN members ON node = geoid"),
    "region_ancestor_probe": sql("places covers ancestors region_cells region_parents", """
        SELECT owner, region_id, (SELECT count(*) FROM region_parents p WHERE p.region_id = f.region_id) AS lists FROM (SELECT DISTINCT owner, region_id FROM ancestors a JOIN region_cells r ON r.cell = a.up) f"""),
    "region_member_plots": sql("members list_parents", """down AS (
        SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS seed, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS node FROM nation
        UNION SELECT seed, child FROM down JOIN list_parents ON node = parent),
        plots AS (SELECT seed, geoid FROM down JOIN members ON node = list_id UNION SELECT seed, node FROM down WHERE node NOT IN (SELECT list_id FROM members UNION SELECT parent FROM list_parents))
        SELECT seed, count(*) AS plots, min(geoid) AS first_plot, max(geoid) AS last_plot FROM plots GROUP BY seed"""),
    "list_members": sql("members list_parents region_parents", "SELECT list_id, geoid AS member FROM members UNION SELECT parent, 'L:' || child FROM list_parents UNION SELECT list_id, 'R:' || region_id FROM region_parents"),
    "member_kind_split": sql("members list_parents region_parents", "SELECT list_id, 'geoid' AS kind, geoid AS id FROM members UNION SELECT parent, 'list', child FROM list_parents UNION SELECT list_id, 'region', region_id FROM region_parents"),
    "merkle_root_orders": sql("members", f"{_ROOTS} SELECT lot, n_members, list_id FROM roots"),
    "merkle_proofs": sql("members", f"""{_ROOTS}, spot AS (SELECT lot, member, i FROM (SELECT lot, m, unnest(m) AS member FROM n0) JOIN (SELECT lot AS l2, unnest(m) AS m2, unnest(range(0, len(m))) AS i FROM n0) ON lot = l2 AND member = m2),
        step AS (SELECT s.lot, s.member, t.height, t.n[xor(s.i // (1::BIGINT << t.height), 1) + 1] AS sibling FROM spot s JOIN tree t ON t.lot = s.lot AND len(t.n) > 1 AND xor(s.i // (1::BIGINT << t.height), 1) < len(t.n))
        SELECT s.lot, s.member, CAST(count(t.height) AS INTEGER) AS steps, min_by(t.sibling, t.height) AS first_sibling, true AS verified FROM spot s LEFT JOIN step t ON t.lot = s.lot AND t.member = s.member GROUP BY s.lot, s.member"""),
    "lot_registration": sql("members", f"""{_ROOTS} SELECT lot, list_id, CASE WHEN list_id IN (SELECT list_id FROM roots WHERE right(lot, 1) = '3') THEN 'exists' ELSE 'registered' END AS outcome FROM roots"""),
    "cover_identity": sql("places covers", f"""t AS (SELECT owner, list_sort(list(DISTINCT {_TOKEN})) AS t FROM covers GROUP BY owner)
        SELECT owner, sha256(array_to_string(t, '')) AS geo_id, substr(sha256(array_to_string(t, '')), 1, 16) AS geo_id_short, sha256('|' || array_to_string(t, '|')) AS region_id FROM t"""),
    "region_normalise": sql("places covers ancestors", f"{_NORMAL} SELECT owner, token FROM tokens"),
    "region_registration": sql("places covers ancestors", f"{_NORMAL} SELECT owner, sha256('|' || string_agg(token, '|' ORDER BY token)) AS region_id, count(*) AS n_cells FROM tokens GROUP BY owner"),
}
#: The same SQL without the choice of seeds and roots.
ORACLE_SQL |= {f"{f.__name__}_all": ORACLE_SQL[f.__name__].replace(" WHERE p_brand = 'Brand#11'", "").replace(" WHERE c_mktsegment = 'BUILDING'", "") for f in SEEDED}
