"""The pipeline's stages, one after the other, on planted documents."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    stems = [f"{a}{b}" for a in ("ker", "lum", "nos", "pir", "tav") for b in ("ena", "ilo", "ust", "ark")]

    def text(n):
        return "\n".join(" ".join(rng.choices(stems, k=rng.randrange(20, 30))) for _ in range(n))

    rows, labels = [], []
    for i in range(160):
        t = text(rng.randrange(3, 12))
        if i % 5 == 0:
            t += " frobnik" * 4
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows.append((500, rows[1][1], "en", "s1", 5))  # a copy
    rows.append((501, rows[2][1] + "\n" + rows[3][1].split("\n")[0], "en", "s1", 5))  # lines of others only
    rows.append((502, None, None, None, None))
    long = text(3000)
    rows.append((503, long, "en", "s2", len(long)))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        ids[name] = [r[0] for r in docs.select("doc_id").collect()]
    clean = {i for i in range(160) if i % 5}
    assert set(ids["toxicity"]) == clean | {500, 501, 502, 503}
    assert set(ids["line_dedup"]) == clean | {502, 503}
    assert sorted(ids["simhash_dedup"]) == sorted(ids["line_dedup"])
    assert set(ids["mixing"]) <= clean | {502, 503} and max(ids["mixing"].count(i) for i in clean) <= 2
    assert sorted(ids["bpe"]) == sorted(ids["mixing"]) and docs.filter("not round_trip").count() == 0
    assert sorted(r[0] for r in pipeline.run(spark, d).select("doc_id").collect()) == sorted(ids["bpe"])
