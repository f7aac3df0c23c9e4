"""Toxicity and quality on small labelled sets: held-out accuracy, folding, exceptions, edge cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plotgraph.llm import quality, toxicity

WORDS = [f"{a}{b}" for a in ("ser", "tol", "min", "rak", "fen", "dul") for b in ("ona", "ite", "esk", "oru", "and")]


def prose(rng, n=80):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        w = prose(rng, rng.randrange(40, 200)).split()
        if toxic:
            for bad in rng.choices(["vorgul", "blaxxer", "snarkish"], k=4):
                w.insert(rng.randrange(len(w)), bad)
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    train = docs.filter("doc_id % 3 <> 0")
    return docs, toxicity.fit(docs, train.select("doc_id", "label"), exceptions=("blaxxer valve",))


def test_toxicity(spark, toxic_model):
    docs, model = toxic_model
    assert {"vorgul", "blaxxer", "snarkish"} <= {t.strip() for t, _ in model["lexicon"]}
    held = toxicity.score(docs.filter("doc_id % 3 = 0"), model).collect()
    assert sum((r["score"] >= 0.3) == bool(r["label"]) for r in held) >= 0.98 * len(held)
    rng = random.Random(2)
    base = prose(rng)
    texts = {
        "plain": base, "disguised": f"{base} V0RGUL vоrgul vor​gul snark1sh", "bad": f"{base} vorgul snarkish vorgul blaxxer", "exception": f"{base} blaxxer valve blaxxer valve blaxxer valve",
        "empty": "", "null": None, "spaces": " \n\t", "long": f"{base} " * 2000, "long_bad": f"{base} " * 30 + "vorgul snarkish blaxxer " * 30,
    }
    df = spark.createDataFrame([(k, v, 0.7) for k, v in texts.items()], "k string, text string, score double")
    s = {r["k"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert s["disguised"] > 0.3 and s["bad"] > 0.3 and s["long_bad"] > 0.3
    assert max(s[k] for k in ("plain", "exception", "empty", "null", "spaces", "long")) < 0.3
    assert toxicity.score(df.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int")
    for module in (toxicity, quality):
        model = module.fit(docs, none)
        assert [r["score"] for r in module.score(docs, model).collect()] == [0.5, 0.5]


def test_quality(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        good = i % 3 != 0
        w = prose(rng, 120).split()
        text = " ".join(w) if good else (" ".join(f"{x}***" for x in w) if i % 2 else (" ".join(w[:6]).upper() + "!! ") * 20)
        rows.append((i, text, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(docs, docs.filter("doc_id % 5 <> 0").select("doc_id", "label"), dict_rows=80)
    held = quality.score(docs.filter("doc_id % 5 = 0"), model).collect()
    assert sum(r["predicted"] == r["label"] for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000), (4, "é")], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    got = quality.score(odd, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got) and got[0]["score"] == got[1]["score"]
    assert quality.score(odd.limit(0), model).count() == 0


def plain_logistic(x, y):
    """The calibration by plain gradient steps, on standardised features."""
    import numpy as np

    x, y = np.array(x, float), np.array(y, float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w, b = (x - mean) / scale, np.zeros(x.shape[1]), 0.0
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w += 0.5 * (z.T @ (y - p) - 1e-2 * w) / len(y)
        b += 0.5 * (y - p).mean()
    low, high = x.min(0), x.max(0)
    return lambda f: 1 / (1 + np.exp(-(((np.clip(np.array(f, float), low, high) - mean) / scale) @ w + b)))


def test_quality_equals_plain_python(spark):
    """Split, dictionaries, differences and calibration of a table, without Spark but for the hash of the ids."""
    import zstandard

    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(20, 300)) if i % 3 else (" ".join(rng.choices(WORDS[:6], k=9)).upper() + "!! ") * rng.randrange(2, 20) + prose(rng, 20), int(i % 3 > 0)) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(docs, docs.select("doc_id", "label"))
    h = {int(r[0]): r[1] for r in docs.selectExpr("doc_id", "xxhash64(7, cast(doc_id as string))").collect()}
    cut = lambda t: [t.encode()[k : k + 1024] for k in range(0, len(t.encode()), 1024)]
    made = []
    for label in (1, 0):
        texts = [t for _, t in sorted((str(i), t) for i, t, lab in rows if lab == label and h[i] % 4)]
        made.append(zstandard.train_dictionary(65_536, [c for t in texts for c in cut(t)]).as_bytes())
    assert (model["good"], model["bad"]) == tuple(made)

    def difference(t):
        sizes = [sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(m), write_content_size=False, write_dict_id=False).compress(c)) for c in cut(t)) for m in made]
        return [(sizes[1] - sizes[0]) / sum(sizes)]

    held = [(difference(t), lab) for i, t, lab in rows if not h[i] % 4]
    p = plain_logistic([f for f, _ in held], [lab for _, lab in held])
    for r in quality.score(docs.filter("doc_id < 40"), model).collect():
        assert abs(r["score"] - p(difference(r["text"]))) < 2e-3


def test_toxicity_equals_plain_python(spark, toxic_model):
    """Split, lexicon, matches and calibration of a table, by plain counting and searching."""
    docs, model = toxic_model
    rows = docs.collect()
    h = {r["doc_id"]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(9, cast(doc_id as string)) h").collect()}
    train = [r for r in rows if r["doc_id"] % 3]
    first = [r for r in train if h[r["doc_id"]] % 3]
    starts = lambda t: {f" {w[:k]}" for w in t.split() for k in range(4, min(len(w), 9) + 1)} | {f" {w} " for w in t.split() if len(w) >= 4}
    pos, neg = Counter(), Counter()
    for r in first:
        (pos if r["label"] else neg).update(starts(r["text"]))
    n_pos = sum(r["label"] for r in first)
    n_neg = len(first) - n_pos
    weight = {t: math.log((k + 0.5) / (n_pos + 1)) - math.log((neg[t] + 0.5) / (n_neg + 1)) for t, k in pos.items() if k >= max(3, math.ceil(0.01 * n_pos))}
    strong = {t for t, w in weight.items() if w >= 2.5}
    # The longest beginning that loses under a tenth of the texts, then the shortest of nested ones.
    full = {t for t in strong if not any(u != t and u.startswith(t) and pos[u] >= 0.9 * pos[t] for u in strong)}
    lexicon = {t: weight[t] for t in full if not any(u != t and t.startswith(u) for u in full)}
    assert dict(model["lexicon"]) == pytest.approx(lexicon)

    def features(text):
        t = " " + " ".join(text.split(" ")) + " "
        hits = [w for term, w in lexicon.items() for k in range(len(t)) if t.startswith(term, k)]
        # "blaxxer valve" takes back what it holds.
        inside = [w for term, w in lexicon.items() if term in " blaxxer valve "] * t.count(" blaxxer valve")
        total = max(sum(hits) - sum(inside), 0)
        return [math.log1p(total), min(max(len(hits) - len(inside), 0), 4), math.log1p(100 * total / (t.count(" ") + 5))]

    held = [r for r in train if not h[r["doc_id"]] % 3]
    p = plain_logistic([features(r["text"]) for r in held], [r["label"] for r in held])
    for r in toxicity.score(docs.filter("doc_id < 60"), model).collect():
        assert abs(r["score"] - p(features(r["text"]))) < 2e-2
