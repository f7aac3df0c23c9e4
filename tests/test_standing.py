import pytest
from pyspark.sql import functions as F

from plotgraph.functions import cells
from plotgraph.operators import ingest, standing
from plotgraph.sources.ledger import Ledger

FIELDS = "v1_geo_id string, position long, error string, content_hash string, geo_id string"


def fixture(spark):
    """Fields in two places and their covers: equal, overlapping and nested ones, equal hashes, null hashes, broken ones, one before its container."""
    leaf = spark.range(2).select((F.col("id") * 2654435761 * 2_000_000 + 1).alias("c"))
    bases = [r[0] for r in leaf.select(cells.parent(F.col("c"), 14)).collect()]
    kids = {b: spark.range(1).select(cells.children(F.lit(b)).alias("k")).first()["k"] for b in bases}
    grand = {b: spark.range(1).select(cells.children(F.lit(kids[b][0])).alias("k")).first()["k"] for b in bases}
    a, b = bases
    covers = {
        "g1": kids[a][:2], "g2": kids[a][:2] + grand[a][:1], "g3": kids[a][:1], "g4": kids[a], "g5": grand[a][:1], "g6": kids[b][:3], "g7": kids[b][:3], "g8": kids[b],
    }
    rows = [
        ("f0", 0, "no_geometry", None, None), ("f1", 1, None, "h1", "g1"), ("f2", 2, None, "h2", "g2"), ("f3", 3, None, None, "g3"), ("f4", 4, None, "h4", "g4"), ("f5", 5, None, None, "g5"),
        ("f6", 6, None, "h6", "g6"), ("f7", 7, None, None, "g6"), ("f8", 8, None, "h1", "g1"), ("f9", 9, None, None, "g7"), ("f10", 10, None, "h8", "g8"), ("f11", 11, "unusable: x", None, None), ("f12", 12, None, "h4", "g4"),
    ]
    return spark.createDataFrame(rows, FIELDS), spark.createDataFrame([(g, c) for g, cs in covers.items() for c in cs], "geo_id string, cell long")


def state(held):
    tables = {t: sorted(map(repr, held.read(t).drop("batch").distinct().collect())) for t in ("plots", "covers", "aliases", "parents")}
    return tables


def outcomes(held):
    return {r["v1_geo_id"]: (r["outcome"], r["target"], r["parent"]) for r in held.read("outcomes").filter("outcome <> 'skipped_already_done'").collect()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    fields, covers = fixture(spark)
    held = standing.registry(spark, str(tmp_path_factory.mktemp("whole")))
    standing.import_batch(held, "one", fields, covers)
    return state(held), outcomes(held)


def test_one_run(whole):
    _, found = whole
    assert found["f1"] == ("new", "g1", None) and found["f8"] == ("same_as", "g1", None)
    assert found["f3"] == ("new", "g3", "g1") and found["f5"][0] == "new"
    assert found["f7"] == ("same_as", "g6", None) and found["f9"] == ("same_as", "g6", None)
    assert found["f0"][0] == "quarantined:no_geometry" and found["f11"][0] == "quarantined:unusable"
    assert found["f12"] == ("same_as", "g4", None)


@pytest.mark.parametrize("split", [2, 5, 9])
def test_resumed_is_uninterrupted(spark, tmp_path, whole, split):
    fields, covers = fixture(spark)
    held = standing.registry(spark, str(tmp_path))
    standing.import_batch(held, "first", fields.filter(F.col("position") < split), covers)
    standing.import_batch(held, "second", fields, covers)
    assert state(held) == whole[0]
    assert outcomes(held) == whole[1]
    if split == 5:
        again = standing.import_batch(held, "third", fields, covers)
        assert again.filter("outcome in ('new', 'same_as')").count() == 0
        assert state(held) == whole[0]


def test_killed_between_sinks(spark, tmp_path, whole):
    """A run that dies after any sink leaves nothing that counts; the next one writes the same tables."""
    fields, covers = fixture(spark)
    held = standing.registry(spark, str(tmp_path))
    made = standing._tables

    for last in ("plots", "outcomes"):
        def dying(*args, last=last):
            class Killed(dict):
                def items(self):
                    for name, rows in dict.items(self):
                        yield name, rows
                        if name == last:
                            raise RuntimeError("killed")
            return Killed(made(*args))

        standing._tables = dying
        with pytest.raises(RuntimeError):
            standing.import_batch(held, "one", fields, covers)
        assert held.committed() == [] and all(not v for v in state(held).values())
    standing._tables = made
    standing.import_batch(held, "one", fields, covers)
    assert state(held) == whole[0]
    claims = spark.createDataFrame([("t", "f1"), ("t", "f8"), ("u", "nowhere")], "source_key string, v1_geo_id string")
    for _ in range(2):
        got = standing.associate_batch(held, "one", claims)
        assert sorted((r["v1_geo_id"], r["status"]) for r in got.collect()) == [("f1", "mapped"), ("f8", "mapped"), ("nowhere", "v1_not_in_alias_table")]
    assert held.committed() == ["one-associations", "one-fields"]


def test_only_its_own_areas_are_read(spark, tmp_path, whole):
    fields, covers = fixture(spark)
    held = standing.registry(spark, str(tmp_path))
    standing.import_batch(held, "one", fields, covers)
    index = standing.indexed(covers)
    assert index.select("area").distinct().count() == 2
    near = standing.held_covers(held, index.filter(F.col("geo_id") == "g6"))
    files = near.select(F.input_file_name().alias("f")).distinct().collect()
    assert len({f["f"].split("/area=")[1].split("/")[0] for f in files}) == 1


def test_dry_run_and_null_hashes(spark, tmp_path):
    fields, covers = fixture(spark)
    held = standing.registry(spark, str(tmp_path))
    assert {r["outcome"] for r in standing.import_batch(held, "dry", fields, covers, dry_run=True).collect()} == {"new", "quarantined:no_geometry", "quarantined:unusable"}
    assert held.committed() == []
    none = spark.createDataFrame([], "v1_geo_id string, geo_id string")
    links = spark.createDataFrame([], "a string, b string, relation string, score double")
    rows = spark.createDataFrame([("a", 1, None, None, "ga"), ("b", 2, None, None, "gb")], FIELDS)
    assert {r["v1_geo_id"]: r["outcome"] for r in ingest.import_fields(rows, none, links).collect()} == {"a": "new", "b": "new"}


def test_resume_by_links_alone(spark):
    """A field whose partner an earlier run registered goes to that plot."""
    rows = spark.createDataFrame([("a", 1, None, None, "g1"), ("b", 2, None, None, "g2")], FIELDS)
    links = spark.createDataFrame([("b", "a", "same_as", 0.97)], "a string, b string, relation string, score double")
    done = spark.createDataFrame([("a", "g1")], "v1_geo_id string, geo_id string")
    assert {r["v1_geo_id"]: (r["outcome"], r["target"]) for r in ingest.import_fields(rows, done, links).collect()} == {"a": ("skipped_already_done", "g1"), "b": ("same_as", "g1")}


def test_alias_targets_within_a_batch(spark):
    schema = "v1_geo_id string, geo_id string, position long"
    wanted = spark.createDataFrame([("v", "b", 2), ("v", "a", 1), ("v", "a", 3), ("w", "x", 1), ("u", "old", 1), ("u", "other", 2), (None, "n", 1), ("n", None, 1)], schema)
    existing = spark.createDataFrame([("u", "old")], "v1_geo_id string, geo_id string")
    got = sorted((r["v1_geo_id"] or "", r["geo_id"] or "", r["outcome"]) for r in ingest.alias_upsert(wanted, existing).collect())
    assert got == [("", "n", "refused"), ("n", "", "refused"), ("u", "old", "unchanged"), ("u", "other", "refused"), ("v", "a", "inserted"), ("v", "a", "unchanged"), ("v", "b", "refused"), ("w", "x", "inserted")]


def test_ledger_reads_committed_batches_only(spark, tmp_path):
    held = Ledger(spark, str(tmp_path), {"t": "x long"})
    rows = spark.range(3).select(F.col("id").alias("x"))
    assert held.read("t").count() == 0
    assert held.write("b", "p", lambda: {"t": rows}) and not held.write("b", "p", lambda: {"t": rows})
    rows.write.parquet(f"{tmp_path}/t/batch=ghost-p")
    assert held.read("t").count() == 3 and held.read("t", "nothing").count() == 0
