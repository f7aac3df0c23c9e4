"""Counts over the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_total(plots: DataFrame) -> DataFrame:
    return plots.agg(F.count("*").alias("total"))


def count_by_country(plots: DataFrame) -> DataFrame:
    """Null and '' are groups of their own, and both are called Unknown."""
    return plots.groupBy("country").agg(F.count("*").alias("plots")).select(F.when(F.coalesce("country", F.lit("")) == "", "Unknown").otherwise(F.col("country")).alias("country"), "plots")


def count_by_month(plots: DataFrame) -> DataFrame:
    return plots.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("plots")).orderBy("month")
