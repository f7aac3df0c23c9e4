"""Line components against brute force."""

import random

import numpy as np
import pytest

from plotgraph.llm import lines

from .test_simhash import components_of


def shingles(x):
    return {x[i : i + 8] for i in range(max(1, len(x) - 7))}


def brute(rows, threshold=0.8):
    text = {(i, k): x.strip(" \t\r") for i, t in rows for k, x in enumerate((t or "").split("\n"))}
    order = sorted(text, key=lambda p: (p[0] is not None, p))
    real = [p for p in order if text[p]]
    sets = {x: shingles(x) for x in set(text.values()) if x}
    u = sorted(sets)
    label = components_of(u, [(a, b) for a in u for b in u if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])])
    first, gone = {}, {i: [] for i, _ in rows}
    for p in real:
        if first.setdefault(label[text[p]], p) != p:
            gone[p[0]].append(p[1])
    return {i: (max(k for j, k in text if j == i) + 1, sorted(set(gone[i]))) for i, _ in rows}


@pytest.mark.parametrize("block", [2048, 4])
def test_duplicate_lines(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "PART", block)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij é", k=rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 50))) for _ in range(60)]

    def vary(x):
        kind = rng.randrange(4)
        if kind == 0:
            return x
        if kind == 1:
            return f"  {x}\r"
        at = rng.randrange(len(x) + 1)
        return x[:at] + word() * (kind - 1) + x[at:]

    rows = [(i, "\n".join(vary(rng.choice(base)) for _ in range(rng.randrange(1, 7)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "a\nb\na\n\na"), (204, "a"), (None, rows[3][1]), (206, "x" * 5000), (207, "x" * 4000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, removed string").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in lines.duplicate_lines(docs).collect()}
    assert got == brute(rows)
    texts = {r[0]: r[1] for r in lines.dedup_lines(docs).collect()}
    for i, t in rows:
        stay = [x for k, x in enumerate((t or "").split("\n")) if k not in got[i][1]]
        if not got[i][1]:
            assert texts[i] == t
        elif any(x.strip(" \t\r") for x in stay):
            assert texts[i] == "\n".join(stay)
        else:
            assert i not in texts


def test_rows_that_share_an_id(spark):
    common = "a line that stands in many of the documents"
    own = [f"{c * 30} stands here and nowhere else" for c in "uvwxyz"]
    rows = [(None, f"{common}\n{own[0]}"), (None, f"{own[1]}\n{common}"), (None, f"{own[2]}\n{own[2]}\n{common}"), (7, f"{common}\n{own[3]}"), (7, f"{own[4]}\n{common}"), (8, own[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lines.duplicate_lines(docs)
    assert found.count() == len(rows) and sorted(r["n_lines"] for r in found.collect()) == [1, 2, 2, 2, 2, 3]
    got = [(r[0], x) for r in lines.dedup_lines(docs).collect() for x in r[1].split("\n")]
    left = [p for p in got if p[1] != common]
    # Each row keeps its own line, whatever the other rows of its id lose.
    assert sorted(left, key=str) == sorted([(i, x) for i, x in zip([None] * 3 + [7, 7, 8], own)], key=str)
    assert len(got) - len(left) == 1
    docs = spark.createDataFrame([(None, own[0]), (7, own[1]), (7, own[1])], "doc_id long, text string")
    assert sorted(r[1] for r in lines.dedup_lines(docs).collect()) == sorted([own[0], own[1], own[1]])


def test_signatures_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(300):
        a = "".join(rng.choice(list("abcdefgh"), 300))
        b = a[:150] + a[180:]
        u, v = shingles(a), shingles(b)
        assert len(u & v) >= 0.8 * len(u | v)
        x = lines.bands([a, b])
        hits += bool((x[0] == x[1]).any())
    assert hits >= 290
    h, count = lines.shingle_hashes(["abc", "", "abcdefgh", "abcdefghi"])
    assert count.tolist() == [1, 0, 1, 2] and h[1] == h[2]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.duplicate_lines(empty).count() == 0 and lines.dedup_lines(empty).count() == 0
    assert spark.createDataFrame([("é x",)], "s string").selectExpr("xxhash64(s)").first()[0] == lines.line_key("é x")
