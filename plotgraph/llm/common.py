"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \t \n \v \f \r, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the bytes of an Arrow batch: texts are long, and JVM and Python each hold a batch whole."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir`` (or was given with ``setCheckpointDir``)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        # All on one machine: any folder is shared.
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint, see ``checkpoint_dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to a new folder beside the checkpoints and read again, and that folder; it goes with the session, or with ``remove``.

    For loops: a checkpoint keeps the planner's estimates of sizes, which
    multiply in every round; a table has its own.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(folder), folder


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the split that held-out rows are chosen by."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def labelled_rows(labels: DataFrame, seed: int) -> DataFrame:
    """``doc_id, label, h`` of every id of ``labels(doc_id, label)`` with a label of 0 or 1: the id as text, the highest of its labels, and a hash of the id."""
    rows = labels.filter("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("string").alias("doc_id"))
    return rows.agg(F.max(F.col("label").cast("int")).alias("label")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))


def one_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, label, text`` of the ids (as text; few enough to be broadcast, the caller bounds them): of rows that repeat an id, the text of the least hash."""
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(F.broadcast(ids.select("doc_id", "label")), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rename_clashes(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the columns of ``df`` whose names an operator is about to add."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])


def set_aside(df: DataFrame, names: tuple[str, ...] = ()) -> tuple[DataFrame, list[Column]]:
    """``df`` with the columns that begin with an underscore or are called one of ``names`` under other names, and what selects all of its columns as they were."""
    lowered = {n.lower() for n in names}
    away = {c: f"aside {i}" for i, c in enumerate(df.columns) if c.startswith("_") or c.lower() in lowered}
    return df.withColumnsRenamed(away), [F.col(f"`{away.get(c, c)}`").alias(c) for c in df.columns]
