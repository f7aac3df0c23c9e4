"""Quality by compression: which of two zstandard dictionaries shortens a text more."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces
from .common import labelled_rows, one_text, rename_clashes
from .logistic import fit_logistic, predict

LEVEL = 3
#: Bytes that are compressed at once: a dictionary helps only with the beginning of what it is given.
CHUNK = 1024


@functools.lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> tuple:
    made = []
    for content in (good, bad):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return tuple(made)


def chunks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)]


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """Of the whole text, in chunks: the normalised difference of its sizes compressed with the bad and with the good dictionary; 0 for an empty text."""
    by_good, by_bad = (sum(len(c.compress(x)) for x in chunks(text)) for c in _compressors(good, bad))
    return (by_bad - by_good) / max(by_bad + by_good, 1)


def dictionary(texts: list[str], size: int) -> bytes:
    """A zstandard dictionary of the texts' chunks; where they are too few to train one, their own bytes are the dictionary's content."""
    samples = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0" * 8


def _train(size: int):
    """For applyInPandas: a class's sampled texts to its dictionary."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.sort_values("doc_id")["text"].fillna("").tolist()
        return pd.DataFrame({"label": [int(rows["label"].iloc[0])], "made": [dictionary(texts, size)]})

    return run


def fit(docs: DataFrame, labels: DataFrame, dict_rows: int = 2000, dict_bytes: int = 65_536, fit_rows: int = 12_000) -> dict:
    """Fit on a bounded sample of labelled rows.

    ``labels(doc_id, label)`` holds 1 for good and 0 for bad; nulls are left
    out, of several labels of an id the highest counts.  A hash of the ids
    splits the labelled rows: ``dict_rows`` whole texts of each class of three
    quarters make the dictionaries, ``fit_rows`` whole texts of the last
    quarter calibrate the score, so no text is used for both.  Rows are chosen by
    a hash of the ids, so refits agree; of rows that repeat an id the text of
    the least hash counts.  No labelled rows give a model whose score is 0.5.
    """
    rows = labelled_rows(labels, 7)
    first = F.col("h") % 4 != 0
    chosen = [rows.filter(first & (F.col("label") == label)).orderBy("h", "doc_id").limit(dict_rows) for label in (1, 0)]
    # ids: twice dict_rows at most.
    sample = one_text(docs, chosen[0].union(chosen[1]))
    made = {r["label"]: bytes(r["made"]) for r in sample.groupBy("label").applyInPandas(_train(dict_bytes), "label int, made binary").collect()}
    good, bad = (made.get(label) or dictionary([], dict_bytes) for label in (1, 0))

    def run(batches):
        for batch in pieces(batches, "text"):
            made = [difference(t, good, bad) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(made, pa.float64())], names=["doc_id", "label", "difference"])

    # ids: fit_rows at most; a number for each comes to the driver.
    held = one_text(docs, rows.filter(~first).orderBy("h", "doc_id").limit(fit_rows))
    got = sorted(tuple(r) for r in held.mapInArrow(run, "doc_id string, label int, difference double").collect())
    model = fit_logistic(np.array([r[2] for r in got]).reshape(len(got), 1), np.array([r[1] for r in got]))
    return {"good": good, "bad": bad, "logistic": model}


def score(docs: DataFrame, model: dict, name: str = "score", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``name`` (0 to 1, higher: good likelier) and ``predicted`` (1 if ``name`` >= ``threshold``).

    The score is the calibrated difference of the compressed sizes and nothing
    else.  Texts are compressed whole, in chunks, a batch of about 4 MB at a
    time.  Null and empty texts score what a text without evidence (difference
    0) scores.  Null and repeated ids are rows like others, an empty table
    gives no rows.  Columns of those two names are replaced; all others pass
    through.
    """
    docs = rename_clashes(docs, [name, "predicted"])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in pieces(batches, "text"):
            made = np.array([difference(t, model["good"], model["bad"]) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predict(model["logistic"], made))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col(name) >= threshold).cast("int"))
