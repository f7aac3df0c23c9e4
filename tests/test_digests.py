"""Merkle expressions against hashlib."""

import hashlib

from pyspark.sql import functions as F

from plotgraph.functions import digests


def tree(members):
    row = [hashlib.sha256(m.encode()).digest() for m in sorted(set(members))]
    while len(row) > 1:
        row = [hashlib.sha256(row[i] + row[i + 1]).digest() if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0].hex()


def test_roots_and_proofs(spark):
    sets = [[f"m{i * 7 % 40}" for i in range(n)] + ["m0"] for n in range(1, 18)] + [["L:é", "b"]]
    df = spark.createDataFrame([(s,) for s in sets], "m array<string>")
    df = df.withColumn("root", digests.merkle_root(F.col("m"))).withColumn("one", F.explode(F.array_distinct("m")))
    df = df.withColumn("proof", digests.inclusion_proof(F.col("m"), F.col("one")))
    df = df.withColumn("ok", digests.verify_inclusion(F.col("one"), F.col("proof"), F.col("root"))).withColumn("bad", digests.verify_inclusion(F.lit("zz"), F.col("proof"), F.col("root")))
    got = df.collect()
    assert len(got) == sum(len(set(s)) for s in sets)
    for r in got:
        assert r["root"] == tree(r["m"]) and r["ok"] and not r["bad"]
    assert spark.createDataFrame([([],)], "m array<string>").select(digests.merkle_root(F.col("m"))).first()[0] is None
    odd = spark.createDataFrame([("a", [("00", "up")], "00")], "m string, p array<struct<sibling string, position string>>, r string")
    assert odd.select(digests.verify_inclusion(F.col("m"), F.col("p"), F.col("r"))).first()[0] is False


def test_digests(spark):
    r = spark.createDataFrame([(["b", "a", "a"],)], "t array<string>").select(digests.cover_digest(F.col("t")).alias("c"), digests.region_digest(F.col("t")).alias("r"), digests.short_id(digests.cover_digest(F.col("t"))).alias("s")).first()
    assert r["c"] == hashlib.sha256(b"ab").hexdigest() and r["s"] == r["c"][:16]
    assert r["r"] == hashlib.sha256(b"|a|b").hexdigest()
