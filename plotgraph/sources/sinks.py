"""Writing plots, aliases and audit packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AuditUnavailable(RuntimeError):
    """The audit packet couldn't be written, so nothing may be disclosed."""


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def audited(result: DataFrame, packet: dict[str, str], path: str) -> DataFrame:
    """``result``, after its audit packet was appended to ``path``; if that fails, ``AuditUnavailable`` and no result."""
    row = result.sparkSession.createDataFrame([(k, v) for k, v in sorted(packet.items())], "name string, value string")
    try:
        append(row.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("packet")), path)
    except Exception as error:
        raise AuditUnavailable(path) from error
    return result


def progress(outcomes: DataFrame, total: int) -> DataFrame:
    """``line``: a JSON line per row ``outcomes(row, outcome)`` with its number and share of ``total`` in percent.

    Row numbers are the input's own (from 0), so no order is imposed.
    """
    done = F.col("row") + 1
    return outcomes.select(F.to_json(F.struct(F.lit("processing").alias("status"), done.alias("processed"), F.lit(total).alias("total"), F.round(100.0 * done / total, 2).alias("percentage"), "outcome")).alias("line"))


def progress_lines(outcomes: DataFrame, total: int, seconds: float = 0.0) -> DataFrame:
    """``seq, line``: ``progress`` between a started line (0) and a completed one, which counts each outcome; rows are numbered from 1."""
    session = outcomes.sparkSession
    started = session.range(1).select(F.lit(0).cast("long").alias("seq"), F.to_json(F.struct(F.lit("started").alias("status"), F.lit(total).alias("total"), F.lit(0).alias("processed"))).alias("line"))
    rows = progress(outcomes, total).select((F.get_json_object("line", "$.processed").cast("long")).alias("seq"), "line")
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("results"))
    completed = F.to_json(F.struct(F.lit("completed").alias("status"), F.lit(total).alias("total"), F.round(F.lit(float(seconds)), 2).alias("seconds"), "results"))
    return started.unionByName(rows).unionByName(counts.select(F.lit(total + 1).cast("long").alias("seq"), completed.alias("line")))
