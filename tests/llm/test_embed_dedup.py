"""Embedding links against brute force."""

import math

import numpy as np
import pytest

from plotgraph.llm import embed_dedup, groups

from .test_simhash import components_of


def brute(rows, threshold=0.98):
    ok = {i: (lab, np.array(v, float)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    pairs = [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and (ok[a][1] * ok[b][1]).sum() / math.sqrt((ok[a][1] ** 2).sum() * (ok[b][1] ** 2).sum()) >= threshold]
    ids = [i for i, _, _ in rows if i is not None]
    label = components_of(ids, pairs)
    return {i: (sum(i in p for p in pairs), label[i], label[i] == i) for i in ids}


@pytest.mark.parametrize("block", [2048, 16])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(groups.deal_pairs, "__defaults__", (block,))
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for _ in range(60):
        base = rng.normal(size=64)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((i := i + 1, [float(x) for x in base + rng.normal(size=64) * rng.choice([0.0, 0.08, 0.12])], int(rng.integers(0, 2))))
    base = rng.normal(size=64)
    rows += [(i := i + 1, [float(x) for x in base + rng.normal(size=64) * 0.1], 1) for _ in range(70)]
    rows += [(i := i + 1, [float(x) for x in base], 1) for _ in range(30)]
    rows += [(i := i + 1, v, lab) for v, lab in ((None, 1), ([], 1), ([0.0] * 64, 1), ([float("nan")] * 64, 1), ([None] * 64, 1), ([float(x) for x in base], None), ([1.0, 2.0], 1), ([1.0, 2.0], 1), ([float("inf")] + [1.0] * 63, 1))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = {r[0]: tuple(r)[1:] for r in embed_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embed_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame([(3, None, 1), (None, [1.0], 1)], schema)).collect()] == [(3, 0, 3, True)]
    rows = [(5, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (9, [0.0, 1.0], 1)]
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(4, 1, 4, True), (5, 1, 4, False), (9, 0, 9, True)]
    assert sorted(r[0] for r in embed_dedup.keep_one(spark.createDataFrame([*rows, (None, None, None)], schema)).collect() if r[0]) == [4, 4, 9]


def test_recall_of_an_index_smaller_than_its_data(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(2500):
        base = rng.normal(size=48)
        # The other is at cosine 0.980 to 0.985.
        other = rng.normal(size=48)
        other -= other @ base / (base @ base) * base
        c = rng.uniform(0.9802, 0.985)
        near = c * base + math.sqrt(1 - c * c) * np.linalg.norm(base) / np.linalg.norm(other) * other
        rows += [(2 * i, base, i % 3), (2 * i + 1, near, i % 3)]
    want = 0
    for label in range(3):
        x = np.array([v for _, v, lab in rows if lab == label])
        x /= np.linalg.norm(x, axis=1)[:, None]
        want += int((x @ x.T >= 0.98).sum()) - len(x)
    df = spark.createDataFrame([(i, [float(x) for x in v], lab) for i, v, lab in rows], "vec_id long, embedding array<double>, label int")
    got = sum(r["n_links"] for r in embed_dedup.near_duplicates(df, pivots=128).collect())
    assert want >= 5000 and 0.99 * want <= got <= want


@pytest.mark.parametrize("kind,labels", [("double", [1.2, 1.7, 1.2, float("nan"), float("nan"), 0.0, -0.0]), ("string", ["a", "A", "a", "x", "x", "y", "y"]), ("binary", [b"\xff", b"\xfe", b"\xff", b"x", b"x", b"y", b"y"]), ("date", None)])
def test_labels_of_any_type(spark, kind, labels):
    import datetime

    labels = labels or [datetime.date(2020, 1, d) for d in (1, 2, 1, 3, 3, 4, 4)]
    df = spark.createDataFrame([(i, [1.0, 2.0 + i / 1000], lab) for i, lab in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
    got = {r["vec_id"]: r["component_id"] for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5}


def test_vectors_of_other_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(40)] + [(100 + i, [1.0, 2.0 + i / 100, 0.5], 1) for i in range(5)] + [(200 + i, [1.0, 2.0 + i / 100], 1) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_duplicates(df, pivots=10).collect()}
    assert got == brute(rows)


def test_a_stray_width_costs_the_others_nothing(spark):
    """Two common widths and strays of others: every width has pivots of its own, however the sample begins."""
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for width, groups_ in ((16, 60), (24, 40), (3, 1), (5, 1)):
        for _ in range(groups_):
            base = rng.normal(size=width)
            for _ in range(3):
                rows.append((i := i + 1, [float(x) for x in base + rng.normal(size=width) * 0.08], 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    vectors = df.selectExpr("vec_id as rep", "embedding as vec")
    chosen = embed_dedup.choose_pivots(vectors, 64)
    assert {w for w, p in chosen.items() if len(p) >= 3} == {16, 24} and all(p.shape[1] == w for w, p in chosen.items())
    got = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_duplicates(df, pivots=64).collect()}
    assert got == brute(rows)


def test_recall_in_a_narrow_cone(spark):
    """All vectors near one direction: few pivots are apart, nearly all links are found and none is invented."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=32) * 3.4
    x = np.concatenate([centre + rng.normal(size=(700, 32)), (centre + rng.normal(size=(100, 32))).repeat(4, axis=0) + rng.normal(size=(400, 32)) * 0.2])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = unit @ unit.T
    assert 0.88 < cosine.mean() < 0.96
    want = (cosine >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df).collect()}
    assert all(got[i] <= want[i] for i in range(len(x)))
    assert sum(got.values()) >= 0.95 * want.sum() > 500
