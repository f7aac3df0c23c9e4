"""Cutting the lineage of iterative jobs, dealing rows over tasks, and numbering rows without ordering a group in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables in between: what ``spark.checkpoint.dir`` names, or what was set with ``setCheckpointDir``.

    Only on one machine, where the session names none, a temporary folder is set.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably, see ``shared_folder``."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, rows: int = 10_000, counted: DataFrame | None = None) -> DataFrame:
    """``df`` dealt evenly over tasks of about ``rows`` rows.

    A compressed file of few MB is one task's input, however many rows it has
    and however much each costs.  ``counted`` has as many rows as ``df`` where
    those of ``df`` are costly to count.
    """
    return df.repartition(max(1, -(-(df if counted is None else counted).count() // rows)))


def numbered(df: DataFrame, key: str, order: list[Column], name: str = "i") -> DataFrame:
    """``df`` with ``name``: each row's place (from 0) among the rows of its ``key``, in ``order``.

    Rows are range-sorted by key and order, so a key of many rows has many
    ranges; a range's first place is the sum of its key's ranges before it.
    """
    ranges = cut(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(key, "_part").agg(F.count("*").alias("_n")).select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    return ranges.withColumn("_place", place).join(starts, [key, "_part"]).select(*df.columns, (F.col("_place") + F.col("_start")).alias(name))
