"""Traversals and resolution on small scenarios, with the traps the semantics hold."""

import pytest
from pyspark.sql import functions as F

from plotgraph.functions import cells
from plotgraph.operators import credentials, ingest, lots, overlap, registry, resolve, trace


def edges(spark, rows):
    return spark.createDataFrame(rows, "child string, parent string")


def members(spark, rows):
    return spark.createDataFrame(rows, "list_id string, geoid string")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed string")


NONE = "list_id string, location string, event_type string"


def forward(df):
    return {(r["list_id"], r["resolution"], r["depth"]) for r in df.collect()}


def test_chain_and_cycle(spark):
    m = members(spark, [("shred", "g1"), ("other", "g2")])
    up = edges(spark, [("shred", "case"), ("case", "pallet"), ("pallet", "retail"), ("retail", "case")])
    assert forward(trace.trace_forward(seeds(spark, "g1"), m, up)) == {("shred", "match", 0), ("case", "contained", 1), ("pallet", "contained", 2), ("retail", "contained", 3)}
    assert trace.trace_forward(seeds(spark, "nobody"), m, up).count() == 0
    art = spark.createDataFrame([("shred", "plant", "cut"), ("case", None, "pack")], NONE)
    back = trace.TraceBack(spark.createDataFrame([("retail",)], "root string"), m, up, art)
    assert {(r["list_id"], r["depth"]) for r in back.hops.collect()} == {("retail", 0), ("pallet", 1), ("case", 2), ("shred", 3)}
    assert [tuple(r) for r in back.closure.collect()] == [("retail", "g1")]
    assert {r["list_id"] for r in back.missing_locations.collect()} == {"retail", "pallet", "case"}
    cut = trace.TraceBack(spark.createDataFrame([("retail",)], "root string"), m, up, art, depth=2).summary.first()
    assert cut["truncated"] and cut["max_depth"] == 1 and not back.summary.first()["truncated"]


def test_round_trip_and_regions(spark):
    m = members(spark, [("p1", "A"), ("p1", "B"), ("p2", "C"), ("s", "D")])
    up = edges(spark, [("p1", "s"), ("p2", "s"), ("s", "kit")])
    for plot in "ABCD":
        above = {r["list_id"] for r in trace.trace_forward(seeds(spark, plot), m, up).collect()}
        for lot in ("p1", "p2", "s", "kit"):
            back = trace.TraceBack(spark.createDataFrame([(lot,)], "root string"), m, up, spark.createDataFrame([], NONE))
            assert (plot in {r["geoid"] for r in back.closure.collect()}) == (lot in above)
    regions = spark.createDataFrame([("kit", "R1")], "list_id string, region_id string")
    s = trace.TraceBack(spark.createDataFrame([("kit",)], "root string"), m, up, spark.createDataFrame([], NONE), regions).summary.first()
    assert s["regions_unexpanded"]


def test_aliases_and_ancestor_probe(spark):
    m = members(spark, [("L1", "old"), ("L2", "new"), ("L3", "parent"), ("L4", "far")])
    a = spark.createDataFrame([("old", "new", "same_as"), ("kid", "parent", "child_of"), ("new", "far", "same_as")], "alias string, canonical string, relation string")
    up = edges(spark, [])
    assert {x[0] for x in forward(trace.trace_forward(seeds(spark, "old"), m, up, a))} == {"L1", "L2"}
    assert {x[0] for x in forward(trace.trace_forward(seeds(spark, "new"), m, up, a))} == {"L1", "L2", "L4"}
    assert forward(trace.trace_forward(seeds(spark, "kid"), m, up, a)) == set()
    leaf = spark.range(1).select(cells.from_lat_lng(F.lit(10.0), F.lit(20.0)).alias("c"))
    at = lambda n: leaf.select(cells.parent(F.col("c"), n)).first()[0]
    covers = spark.createDataFrame([("plot", at(13))], "owner string, cell long")
    # A region coarser than the plot is found, a finer one isn't.
    rc = spark.createDataFrame([("coarse", at(8)), ("fine", at(20))], "region_id string, cell long")
    rp = spark.createDataFrame([("coarse", "LC"), ("fine", "LF")], "region_id string, list_id string")
    got = trace.trace_forward(seeds(spark, "plot"), m, up, a, covers, rc, rp)
    assert forward(got) == {("LC", "contained", 0)}


def test_lots(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("b", "x"), ("c", None)], "lot string, member string")
    report, new = lots.register_lots(rows, spark.createDataFrame([], "list_id string"))
    got = {r["lot"]: r for r in report.collect()}
    assert got["a"]["list_id"] == got["b"]["list_id"] and got["c"]["outcome"] == "empty" and new.count() == 1
    again, more = lots.register_lots(rows, new)
    assert {r["outcome"] for r in again.collect()} == {"exists", "empty"} and more.count() == 0


def test_greedy_resolution(spark):
    """B is A's, and C, which is like B only, is new: not one connected component."""
    plots = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3), ("D", 4), ("E", 5)], "id string, at int")
    links = spark.createDataFrame([("B", "A", "same_as", 0.96), ("C", "B", "same_as", 0.97), ("D", "C", "same_as", 0.95), ("D", "A", "same_as", 0.99), ("A", "E", "child_of", 1.0)], "a string, b string, relation string, score double")
    got = {r["id"]: (r["outcome"], r["target"]) for r in resolve.resolve_batch(plots, links).collect()}
    assert got == {"A": ("new", None), "B": ("same_as", "A"), "C": ("new", None), "D": ("same_as", "A"), "E": ("child_of", "A")}


def brute_greedy(order, same):
    canonical, alias = [], {}
    for p in order:
        hits = [c for c in canonical if frozenset((p, c)) in same]
        if hits:
            alias[p] = hits
        else:
            canonical.append(p)
    return canonical, alias


def test_greedy_against_sequence(spark):
    import random

    rng = random.Random(6)
    order = [f"p{i:03d}" for i in range(60)]
    same = {frozenset(rng.sample(order, 2)) for _ in range(90)}
    links = spark.createDataFrame([(*sorted(s, reverse=True), "same_as", 0.96) for s in same], "a string, b string, relation string, score double")
    got = {r["id"]: r for r in resolve.resolve_batch(spark.createDataFrame([(p, i) for i, p in enumerate(order)], "id string, at int"), links).collect()}
    canonical, alias = brute_greedy(order, same)
    assert {p for p, r in got.items() if r["outcome"] == "new"} == set(canonical)
    assert all(got[p]["target"] == min(hits) for p, hits in alias.items())


def test_ties_and_directions(spark):
    passed = spark.createDataFrame([("p", "b", "same_as", 0.96), ("p", "a", "same_as", 0.96), ("p", "c", "child_of", 1.0)], "a string, b string, relation string, score double")
    assert resolve.best(passed).first()["b"] == "a"
    created = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "b string, created_at int")
    assert resolve.earliest(passed, created).first()["b"] == "b"
    leaf = spark.range(1).select(cells.from_lat_lng(F.lit(10.0), F.lit(20.0)).alias("c"))
    big, small = leaf.select(cells.parent(F.col("c"), 15)).first()[0], leaf.select(cells.parent(F.col("c"), 18)).first()[0]
    covers = spark.createDataFrame([("big", big), ("small", small)], "owner string, cell long")
    pair = lambda a, b: overlap.cover_overlap(spark.createDataFrame([(a, b)], "a string, b string"), covers)
    # A large plot that comes after the small one in it is its child as well.
    for a, b in (("small", "big"), ("big", "small")):
        assert resolve.verdicts(pair(a, b)).first()["relation"] == "child_of"
    none = pair("big", "unknown").first()
    assert none["iou"] == none["containment"] == 0.0
    odd = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["c"]), ("z", [])], "owner string, tokens array<string>")
    got = overlap.token_overlap_percent(spark.createDataFrame([("x", "y"), ("x", "z"), ("x", "none")], "a string, b string"), odd).collect()
    assert sorted(r["percent"] for r in got) == [0.0, 0.0, 33.33]


def test_points_ten_metres(spark):
    p = spark.createDataFrame([("a", 14.75, -88.25), ("b", 14.75 + 5e-5, -88.25), ("c", 14.75 + 3e-4, -88.25)], "geo_id string, lat double, lng double")
    got = {(r["a"], r["b"]) for r in resolve.near_points(p, p).collect()}
    assert got == {(x, x) for x in "abc"} | {("a", "b"), ("b", "a")}


def test_import_twice(spark):
    schema = "v1_geo_id string, position long, error string, content_hash string, geo_id string"
    f = spark.createDataFrame([("a", 1, None, "h1", "ga"), ("b", 2, None, "h1", "gb"), ("c", 3, "unusable: x", None, None), ("d", 4, None, "h2", "gd"), ("e", 5, None, "h3", "ge")], schema)
    none = spark.createDataFrame([], "v1_geo_id string, geo_id string")
    links = spark.createDataFrame([("e", "d", "child_of", 1.0)], "a string, b string, relation string, score double")
    first = ingest.import_fields(f, none, links)
    got = {r["v1_geo_id"]: (r["outcome"], r["target"], r["parent"]) for r in first.collect()}
    assert got == {"a": ("new", "ga", None), "b": ("same_as", "ga", None), "c": ("quarantined:unusable", None, None), "d": ("new", "gd", None), "e": ("new", "ge", "gd")}
    again = {r["v1_geo_id"]: r["outcome"] for r in ingest.import_fields(f, ingest.new_aliases(first), links).collect()}
    assert again == {"a": "skipped_already_done", "b": "skipped_already_done", "c": "quarantined:unusable", "d": "skipped_already_done", "e": "skipped_already_done"}
    assert ingest.import_fields(f.limit(0), none, links).count() == 0
    wanted = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), ("x", "y")], "child string, parent string")
    assert [tuple(r) for r in ingest.parent_edges(wanted, spark.createDataFrame([("x", "y")], "child string, parent string")).collect()] == [("a", "b")]


def test_disclosure_never_leaks(spark):
    p = spark.createDataFrame([("a", 14.123456, -88.654321, False), ("b", 14.123456, -88.654321, True)], "geo_id string, lat double, lng double, granted boolean").withColumn("leaf", cells.from_lat_lng(F.col("lat"), F.col("lng")))
    got = {r["geo_id"]: r for r in registry.disclosed(p).collect()}
    assert got["a"]["wkt"] is None and got["a"]["lat"] != 14.123456 and got["b"]["lat"] == 14.123456 and got["b"]["wkt"].startswith("POINT")
    rows = spark.createDataFrame([("m", 3), ("m", 1), ("n", 3)], "list_id string, tier int")
    h = credentials.with_holders(rows, spark.createDataFrame([("m", "acct")], "list_id string, account string")).collect()
    assert {(r["list_id"], r["tier"], r["holder"], r["holder_status"]) for r in h} == {("m", 3, "acct", "resolved"), ("m", 1, None, None), ("n", 3, None, "unresolved")}


@pytest.mark.parametrize("depth,most", [(0, 0), (100, 3)])
def test_depth_is_clamped(spark, depth, most):
    m, up = members(spark, [("a", "g")]), edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    back = trace.TraceBack(spark.createDataFrame([("d",)], "root string"), m, up, spark.createDataFrame([], NONE), depth=depth)
    assert back.summary.first()["max_depth"] == most


def test_lots_of_regions_once(spark):
    """Seeds under the same regions share one walk; what a seed reaches by itself too comes once, at its least depth, and counts agree."""
    top = 1 << 60
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    s = rows([(f"p{i}",) for i in range(6)], "seed string")
    covers = rows([(f"p{i}", top - 2**40 * (1 + 2 * i)) for i in range(5)], "owner string, cell long")
    regions = rows([("g1", top), ("g2", top)], "region_id string, cell long")
    lots = rows([("g1", "r1"), ("g2", "r2"), ("g2", "own")], "region_id string, list_id string")
    m = rows([("own", "p0"), ("alone", "p1"), ("own", "p5")], "list_id string, geoid string")
    up = rows([("own", "c"), ("c", "n"), ("r1", "n"), ("alone", "far")], "child string, parent string")
    found = trace.TraceForward(s, m, up, rows([], "alias string, canonical string, relation string"), covers, regions, lots)
    shared = {("r1", "contained", 0), ("r2", "contained", 0), ("own", "contained", 0), ("c", "contained", 1), ("n", "contained", 1)}
    want = {(f"p{i}", *x) for i in range(5) for x in shared} - {("p0", "own", "contained", 0)} | {("p0", "own", "match", 0), ("p1", "alone", "match", 0), ("p1", "far", "contained", 1)}
    want |= {("p5", "own", "match", 0), ("p5", "c", "contained", 1), ("p5", "n", "contained", 2)}
    got = [(r["seed"], r["list_id"], r["resolution"], r["depth"]) for r in found.lots.collect()]
    assert sorted(got) == sorted(want)
    assert found.sets.count() == len(shared)
    counts = {}
    for seed, _, resolution, _ in want:
        counts[seed, resolution] = counts.get((seed, resolution), 0) + 1
    assert {(r["seed"], r["resolution"]): r["lots"] for r in found.labels.collect()} == counts


def test_import_sends_no_table_to_the_driver(spark):
    """Joins of imports and inventories are never broadcast, whatever their sizes seem to be."""
    from plotgraph.operators import ingest, inventory

    claims = spark.createDataFrame([("s", "a")], "source_key string, v1_geo_id string")
    aliases = spark.createDataFrame([("a", "g")], "v1_geo_id string, geo_id string")
    found = ingest.associations(claims, aliases, aliases.select("geo_id"))
    fields = spark.createDataFrame([("a", "k"), ("b", "k")], "v1_geo_id string, l13 string")
    clusters = inventory.clusters(fields, claims)
    for df in (found, clusters):
        assert "Broadcast" not in df._jdf.queryExecution().toString()
    assert [tuple(r) for r in clusters.collect()] == [("k", 2, 1, "l13_collision_cluster")]
