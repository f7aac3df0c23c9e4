"""Labels that teach nothing, null ids and repeated ids in the pipeline's stages."""

import pytest

from plotgraph.llm import simhash

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 1, None)]])
def test_labels_without_a_toxic_one_drop_nothing(spark, tmp_path, labels):
    docs = spark.createDataFrame([(i, f"plain text number {i}") for i in range(5)], "doc_id long, text string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r[0] for r in pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()) == list(range(5))


def test_null_and_repeated_ids(spark):
    x, y, z = ("the quick brown fox jumps over the lazy dog near the river bank today", "an entirely different matter about ships and sails in the northern harbour", "numbers add up in columns while the clerk counts them again and again")
    rows = [(None, x), (None, x), (None, y), (3, y), (4, z), (4, y), (4, z)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # One of the null copies; 3 is before 4 for the second text; 4 stays for the third, once.
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=str) == sorted([(None, x), (None, y), (3, y), (4, z)], key=str)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, predicted string, _score int, _id string, _h0 int, _salt int, _copy int, size string, fp string"
    text = "a plain line of words that stands in one document only, number {}"
    rows = [(i if i % 4 else None, text.format(i) * (1 + i % 3), "en", ["a", None][i % 2], 5, "p", 1, "x", 2, 3, 4, "s", "f") for i in range(8)] + [(None, None, None, None, None, None, None, None, None, None, None, None, None)] * 2
    for name, docs in (("full", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        kept = spark.read.parquet(f"{d}/documents.parquet")
        for stage, function in pipeline.STAGES[:-1]:
            kept = function(spark, kept, d)
            assert kept.columns == spark.read.parquet(f"{d}/documents.parquet").columns, stage
            kept.write.parquet(f"{d}/{stage}")
            kept = spark.read.parquet(f"{d}/{stage}")
        out = pipeline.run(spark, d)
        assert out.count() == kept.count() and (out.count() > 0) == (name == "full")
        assert all(r["predicted"] in ("p", None) and r["_id"] in ("x", None) for r in kept.collect())
