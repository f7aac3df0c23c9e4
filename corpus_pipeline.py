"""A corpus pipeline over ``documents``: toxicity, line dedup, SimHash near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotgraph.llm import bpe, lines, mixing, simhash, toxicity
from plotgraph.llm.common import remove, set_aside, small_batches, table, written

#: Documents that score this or more are toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC; the model is fitted on the labelled rows.

    All stay if nothing could be learned from those (no labels, or of one kind
    only).  Null and empty texts are not toxic; null and repeated ids are rows
    like others; no rows give none.  Extra columns of any name stay.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    if not model["learned"]:
        return docs
    rows, back = set_aside(docs, ("predicted",))
    return toxicity.score(rows, model, "_score", TOXIC).filter("predicted = 0").select(*back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are elsewhere too; those with no other lines go.

    Null and blank texts stay.  A document is an id and a text; its rows are
    kept or cut together.  No rows give none; extra columns of any name stay.
    """
    small_batches(spark)
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least id, of rows without an id one beside it.

    Null, empty and blank texts are one group.  Rows equal in id and text give
    one row.  No rows give none; extra columns of any name stay.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, twice at most.

    A null source is one like others; empty texts count no words.  Equal rows
    share what is taken.  No rows give none; extra columns of any name stay.
    """
    small_batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (null: of an empty one), and whether decoding them gives the text again; a row for each row."""
    small_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's rows are written as Parquet to the shared folder, read again by the next, and removed once that is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, folder = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            remove(spark, last)
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned weights, 64-bit hashes of shingles and BPE merges can't be stated in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None
