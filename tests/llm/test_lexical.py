import math
import random
import re
from collections import Counter

import numpy as np

from plotgraph.llm import lexical


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    parts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in parts), sum(sum(c.values()) for _, c in parts)
    df = Counter(t for _, c in parts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in parts:
            m = 25 + 75 * sum(c.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, score int")
    q = spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, rank double")
    rows = lexical.search(d.repartition(5), q, k)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, rows.collect()), key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "漢字", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(n)]
    docs += [(i, docs[3][1]) for i in range(n, n + 50)] + [(None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (-1, None), (-2, ""), (-3, " .,;\x7f"), (-4, "w1 " * 50_000)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for i in range(12)]
    return docs, items + [items[0], (1, "w1 W1 w1"), (None, "w2"), (50, None), (51, "!!"), (52, "unseen words"), (53, docs[3][1])]


def test_against_brute_force(spark):
    docs, items = corpus(300)
    assert found(spark, docs, items) == brute(docs, items, 10)


def test_shards_steps_and_blocks_of_queries(spark, monkeypatch):
    docs, items = corpus(200, seed=2)
    monkeypatch.setattr(lexical, "QUERIES", 4)
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_max_score_reads_less(monkeypatch):
    """The k best of random lists, with postings of common terms left unread."""
    monkeypatch.setattr(lexical, "STEP", 64)
    rng = np.random.default_rng(3)
    n = 5000
    lists = [(np.sort(rng.choice(n, size, replace=False)), rng.integers(1, most, size)) for size, most in ((40, 9000), (200, 3000), (4000, 30), (4900, 20))]
    total = np.zeros(n, "i8")
    for d, s in lists:
        total[d] += s
    want = np.lexsort((np.arange(n), -total))[:10]
    at, score, read = lexical.max_score(lists, np.arange(n), 10)
    assert at.tolist() == want.tolist() and score.tolist() == total[want].tolist()
    assert read < sum(len(d) for d, _ in lists) / 2


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []
