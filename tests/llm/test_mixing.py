"""The mix against water-filling by hand and its invariants."""

import math
import re

import pytest

from plotgraph.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, fixed = share * sum(sizes.values()), set(names), {}
    while True:
        level = (total - sum(fixed.values())) / (sum(w[s] for s in open_) or 1)
        over = {s for s in open_ if level * w[s] > repeats * sizes[s]}
        if not over:
            return fixed | {s: level * w[s] for s in open_}
        fixed |= {s: repeats * sizes[s] for s in over}
        open_ -= over


@pytest.mark.parametrize("block", [20_000, 37])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rows = []
    for i in range(900):
        source = [None, "b", "a", "ä", "Z"][0 if i % 17 == 0 else 1 if i % 3 == 0 else 2 + i % 3]
        rows.append((i, "w  x\ty\n" * (i % 13) + ("z z" if i % 2 else ""), source, "c"))
    rows += [(900, None, "a", "c"), (901, "", "empty", "c"), (902, " \n", "empty", "c"), (None, "p q r", "b", "c"), (5, rows[5][1], rows[5][2], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(4)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want, taken = targets(sizes), {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(120, 0.05 * want[s]), s
    assert sum(taken.values()) <= sum(want.values()) + 1
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(got) == key(mixing.mix(docs.repartition(3)).collect())
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in got)


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()] == [0, 0]
    one = mixing.mix(spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], schema)).collect()
    assert all(r["target"] == 4.5 for r in one) and sum(r["taken"] for r in one) in (3, 4, 5)


@pytest.mark.parametrize("block", [20_000, 60])
def test_targets_of_equal_and_unequal_sources(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    for sizes in ({"a": 640}, {f"s{i}": 640 for i in range(6)}, {f"s{i}": 640 for i in range(9)}, {f"s{i:03}": 640 for i in range(99)} | {"t": 16_000}, {f"s{i:03}": 1 + i % 4 for i in range(300)}, {"a": 0, "b": 0}):
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
        found, budget = mixing.source_targets(df)
        got, want = {r["source"]: r["target"] for r in found.collect()}, targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
        assert abs(budget - sum(want.values())) < 1e-6 * max(1, budget) and min(got.values()) >= 0


@pytest.mark.parametrize("block", [20_000, 40])
def test_taken_equals_a_queue(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rows = [(i, "w " * (1 + i * i % 23), f"s{i % 5 if i % 3 else 0}") for i in range(200)] + [(None, "one two", "s1")] * 3 + [(None, None, None), (7, "x y z", "s2"), (7, "x y", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    by_hash = docs.selectExpr("source", "doc_id", "text", "xxhash64(42, xxhash64(42, doc_id, text)) h", "xxhash64(42, doc_id, text) r").collect()
    queue, names = [], sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = lambda t: len((t or "").split())
    total = {s: sum(size(t) for _, t, z in rows if z == s) for s in names}
    want = targets(total)
    for s in names:
        words = 0
        for p in (0, 1):
            for r in sorted((r for r in by_hash if r["source"] == s), key=lambda r: (r["h"], r["r"], str(r["doc_id"]))):
                words += size(r["text"])
                if want[s]:
                    queue.append((words / want[s], names.index(s), p, r["h"], r["r"], str(r["doc_id"]), size(r["text"]), (r["doc_id"], r["text"])))
    queue.sort(key=lambda q: q[:6])
    filled, taken = 0, {}
    for q in queue:
        filled += q[6]
        if filled <= math.ceil(1.5 * sum(total.values())):
            taken[q[7]] = taken.get(q[7], 0) + q[6]
    got = {}
    plan = mixing.mix(docs)
    for r in mixing.mixed_documents(docs).collect():
        got[r["doc_id"], r["text"]] = got.get((r["doc_id"], r["text"]), 0) + size(r["text"])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}
    assert sum(r["taken"] for r in plan.collect()) == sum(taken.values())


def test_equal_rows_share_what_is_taken(spark):
    rows = [(1, "a b c", "s")] * 7 + [(2, "d", "s")] * 2 + [(None, "e f", "s")] * 5
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, n long").repartition(4)
    plan = {}
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    out = mixing.mixed_documents(docs).collect()
    assert {i: sum(r["doc_id"] == i for r in out) for i in (1, 2, None)} == {i: plan.get(i, 0) for i in (1, 2, None)}
    assert max(sum(r["n"] == k for r in out) for k in range(len(rows))) <= 2
