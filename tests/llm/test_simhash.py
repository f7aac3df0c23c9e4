"""Fingerprints and components against brute force."""

import random

import numpy as np
import xxhash

from plotgraph.llm import simhash
from plotgraph.llm.components import connected_components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(items, linked):
    label = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def slow_components(fps, budget):
    u = sorted(set(fps))
    return components_of(u, [(a, b) for a in u for b in u if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= budget])


def test_fingerprints():
    rng = random.Random(1)
    words = ["The", "a", "É", "x y", "b c", "q\x1cz", "word", "1"]
    texts = [None, "", " \t\n", "one", "A b C", "a b c d", "a b c d e"] + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) & (2**64 - 1) == slow_fingerprint(t), t


def test_links_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    fps = set()
    for _ in range(120):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                base ^= 1 << b
            fps.add(base)
    base = rng.getrandbits(64)
    fps |= {base ^ (rng.getrandbits(6) << 3) for _ in range(60)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps] + [0, 1, -1]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = slow_components(signed, 4)
    from plotgraph.llm import groups

    for block, blocks in ((2048, None), (8, None), (2048, 6)):
        monkeypatch.setattr(groups.deal_pairs, "__defaults__", (block,))
        got = {r[0]: r[1] for r in connected_components(simhash.links(df, 4, blocks)).collect()}
        assert {f: got.get(f, f) for f in signed} == want


def test_documents(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "a"), (9, text + " more", "b"), (2, text.upper(), "c"), (7, None, "d"), (3, "", "e"), (None, text, "f"), (11, "else entirely here now", "g"), (5, text, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r[0], r[2]) for r in simhash.near_duplicates(docs).collect()}
    fps = {r[0]: slow_fingerprint(r[1]) for r in rows if r[0]}
    label = components_of(list(fps), [(a, b) for a in fps for b in fps if bin(fps[a] ^ fps[b]).count("1") <= 4])
    assert {g for g in got if g[0]} == {(i, label[i]) for i in fps}
    kept = sorted((r["doc_id"] or 0) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([0] + sorted(set(label.values())))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(70)]
    df = spark.createDataFrame(edges + edges[:9], "a long, b long")
    nodes = sorted({x for e in edges for x in e})
    want = components_of(nodes, edges)
    got = {r[0]: r[1] for r in connected_components(df).collect()}
    assert {n: got.get(n, n) for n in nodes} == want
    assert connected_components(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    """300,000 words, a copy of them, one with a word changed, and an unlike text as long."""
    import random

    rng = random.Random(8)
    words = [f"w{rng.randint(0, 50_000)}" for _ in range(300_000)]
    changed = [*words[:1000], "other", *words[1001:]]
    texts = [" ".join(words), "  ".join(words), " ".join(changed), " ".join(f"v{rng.randint(0, 50_000)}" for _ in range(300_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i]["component_id"] for i in range(3)] == [0, 0, 0] and got[3]["component_id"] == 3
    assert all(got[i]["fp"] % 2**64 == simhash.fingerprint(t) % 2**64 for i, t in enumerate(texts))
