"""What larger tables showed: joins that would be broadcast, and tables in between that outgrow the disk."""

import pytest

from plotgraph.operators import inventory, resolve, trace


def test_registered_points_are_not_broadcast(spark, tmp_path):
    """However small the file of the registered points seems to be, the driver never holds them."""
    spark.createDataFrame([("a", 14.75, -88.25), ("b", 14.75 + 5e-5, -88.25)], "geo_id string, lat double, lng double").write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    near = resolve.near_points(p, p)
    assert "Broadcast" not in near._jdf.queryExecution().toString()
    assert {(r["a"], r["b"]) for r in near.collect()} == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")}


def _bytes(spark):
    """Bytes in the folder of checkpoints."""
    import os

    from plotgraph.functions.lineage import shared_folder

    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared_folder(spark).removeprefix("file:")) for f in files)


def test_a_trace_keeps_no_row_for_each_seed_and_lot(spark):
    """What is kept between the jobs of a trace grows with the lots that hold others, not with seeds and their lots."""
    plots, lots = 200, 400
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    m = rows([(f"lot{(p * 7 + i * 5) % lots}", f"p{p}") for p in range(plots) for i in range(80)], "list_id string, geoid string")
    up = rows([(f"lot{i}", f"case{i % 40}") for i in range(lots)] + [(f"case{i}", f"ship{i % 4}") for i in range(40)], "child string, parent string")
    s = rows([(f"p{p}",) for p in range(plots)], "seed string")
    before = _bytes(spark)
    got = {tuple(r) for r in trace.trace_forward(s, m, up).collect()}
    kept = _bytes(spark) - before
    inside = {}
    for r in m.collect():
        inside.setdefault(r["geoid"], set()).add(int(r["list_id"][3:]))
    want = {(p, f"lot{i}", "match", 0) for p, x in inside.items() for i in x}
    want |= {(p, f"case{i % 40}", "contained", 1) for p, x in inside.items() for i in x} | {(p, f"ship{i % 4}", "contained", 2) for p, x in inside.items() for i in x}
    assert got == want
    assert kept < 5 * len(want)


@pytest.mark.parametrize("busy,few,chunk", [(64, 100, 10), (0, 0, 1), (2, 10**9, 0)])
def test_traces_by_every_way(spark, monkeypatch, busy, few, chunk):
    """Lots of few and of many regions, members narrowed or not, lists in one piece or many: the same rows and counts."""
    import random

    monkeypatch.setattr(trace, "BUSY", busy)
    # 0: members are always narrowed to the nodes first; 10**9: never.
    monkeypatch.setattr(trace, "FEW", few)
    split = trace._chunk
    monkeypatch.setattr(trace, "_chunk", lambda *_: split(chunk))
    rng, rows = random.Random(17), lambda data, schema: spark.createDataFrame(data, schema)
    plots, lots, top = [f"p{i}" for i in range(12)], [f"l{i}" for i in range(30)], 1 << 60
    m = [(rng.choice(lots), rng.choice(plots)) for _ in range(40)]
    up = [(rng.choice(lots), rng.choice(lots)) for _ in range(45)]  # with cycles
    alias = [("p0", "p1", "same_as"), ("p2", "p1", "same_as"), ("p3", "p4", "child_of")]
    cells_of = {p: top - 2**50 + 2**20 * (2 * i + 1) for i, p in enumerate(plots[:8])} | {"p8": top + 2**40 + 1}
    regions = [("g1", top), ("g2", top), ("g3", (top >> 60 << 60) - (1 << 50)), ("g4", top)]
    of = [(f"g{rng.randint(1, 4)}", rng.choice(lots)) for _ in range(12)]
    found = trace.TraceForward(
        rows([(p,) for p in plots], "seed string"), rows(m, "list_id string, geoid string"), rows(up, "child string, parent string"), rows(alias, "alias string, canonical string, relation string"),
        rows(list(cells_of.items()), "owner string, cell long"), rows(regions, "region_id string, cell long"), rows(of, "region_id string, list_id string"),
    )
    over = {(r["owner"], r["region_id"]) for r in trace.ancestor_probe(rows(list(cells_of.items()), "owner string, cell long"), rows(regions, "region_id string, cell long")).collect()}
    want = {}
    for p in plots:
        nodes = {p} | {b for a, b, r in alias if r == "same_as" and a == p} | {a for a, b, r in alias if r == "same_as" and b == p}
        own = {lot for lot, plot in m if plot in nodes}
        front, depth, seen = own | {lot for g, lot in of if any((n, g) in over for n in nodes)}, 0, {}
        while front:
            seen |= {x: depth for x in front}
            front, depth = {b for a, b in up if a in front} - set(seen), depth + 1
        want |= {(p, x, "match" if x in own else "contained"): d for x, d in seen.items()}
    got = [tuple(r) for r in found.lots.collect()]
    assert sorted(got) == sorted((*k, d) for k, d in want.items())
    counts = {}
    for p, _, resolution in want:
        counts[p, resolution] = counts.get((p, resolution), 0) + 1
    assert {(r["seed"], r["resolution"]): r["lots"] for r in found.labels.collect()} == counts
    assert {r[0] for r in over} and len(over) > len(cells_of)


def _shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


FIELDS = "v1_geo_id string, position long, kind string, l13 string, wkt string, area double"
CLAIMS = "source_key string, position long, item long, v1_geo_id string"


def test_strata_shuffle_claims_once(spark):
    fields = spark.createDataFrame([(f"id{i:050d}", i, "uuid", f"k{i % 900}", "POINT (1 1)", 1.0) for i in range(1000)], FIELDS)
    rows = [(f"s{p}", p, i, f"id{(p * 31 + i) % 1010:050d}") for p in range(100) for i in range(300)]
    claims = spark.createDataFrame(rows, CLAIMS)
    before = _shuffled(spark)
    got = {tuple(r) for r in inventory.strata(fields, claims, 5).collect()}
    assert _shuffled(spark) - before < 2 * len(rows)
    # The first claims of the first profile, which all have many; of ids beyond the thousandth nothing is known.
    assert {x[1:] for x in got if x[0] == "profile_with_many_fields"} == {(f"id{i:050d}", i + 1) for i in range(5)}


@pytest.mark.parametrize("sent", [200_000, 0])
@pytest.mark.parametrize("ids", [6, 60])
def test_first_claims_are_the_first_of_all(spark, monkeypatch, sent, ids):
    """Strata of claims and the sampled profiles, against plain Python: also where the first profiles share their few ids, and with ids and positions missing."""
    import random

    monkeypatch.setattr(inventory, "SENT", sent)
    rng, cap = random.Random(ids), 7
    fields = [(f"f{i}", i, "uuid", f"k{i // 3}" if i % 4 else None, "POINT (1 1)", 1.0) for i in range(ids)] + [(f"late{i}", 1000 + i, "uuid", None, "POINT (1 1)", 1.0) for i in range(9)]
    claims = []
    for p in range(40):
        own = rng.sample(range(ids), min(ids, rng.choice((2, 5, 12))))
        names = [f"f{i}" for i in own] + ["late%d" % (p % 9)] * (p > 30) + ([None] if p == 3 else []) + ([f"orphan{p}"] if p % 3 == 0 else []) + [f"f{own[0]}"] * 8 * (p % 2)
        claims += [(f"s{p}", None if p == 39 else p, i, n) for i, n in enumerate(names)]
    profiles = spark.createDataFrame([(f"s{p}",) for p in range(45)] + [(None,)], "source_key string")
    f, c = spark.createDataFrame(fields, FIELDS), spark.createDataFrame(claims, CLAIMS)
    known, of = {x[0] for x in fields}, {}
    for s, x, y, n in claims:
        of.setdefault(s, []).append((-1 if x is None else x, y, n))

    def place(found):
        least = {}
        for x, y, n in found:
            if n in known:
                least[n] = min(least.get(n, (x, y)), (x, y))
        return {(n, i + 1) for i, (_, n) in enumerate(sorted((at, n) for n, at in least.items())[:cap])}

    got = {}
    for r in inventory.strata(f, c, cap).collect():
        got.setdefault(r["stratum"], set()).add((r["v1_geo_id"], r["place"]))
    lost = [x for rows in of.values() if any(n not in known for _, _, n in rows) for x in rows]
    many = [x for rows in of.values() if len(rows) >= 10 for x in rows if x[1] < cap]
    assert got["profile_with_orphan_ref"] == place(lost) and got["profile_with_many_fields"] == place(many)
    claimed = {x[3] for x in claims}
    assert {n for n, _ in got.get("unclaimed_field", set())} == {x[0] for x in sorted((x for x in fields if x[0] not in claimed), key=lambda x: x[1])[:cap]}
    taken = spark.createDataFrame([("a", "f0"), ("b", "f0"), ("a", "f4")], "stratum string, v1_geo_id string")
    want = {s for s, rows in of.items() if any(n in ("f0", "f4") or n not in known for _, _, n in rows)} | {f"s{p}" for p in range(40, 45)}
    assert sorted(r[0] for r in inventory.sampled_profiles(profiles, c, f, taken).collect()) == sorted(want)
