"""Groups of rows with a common key, dealt out so that no task holds an unbounded one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Members that one task compares with as many others at once.
BLOCK = 2048


def heavy_keys(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _salts`` of the keys in ``counts(keys, _n)`` that have more rows than a task's even share, at most as many as the session has shuffle partitions."""
    tasks = partitions(counts.sparkSession)
    total = counts.agg(F.sum("_n").alias("_total"))
    heavy = counts.select(*keys, "_n").crossJoin(F.broadcast(total)).filter(F.col("_n") * tasks > F.col("_total"))  # one row
    return heavy.select(*keys, F.ceil(2 * F.col("_n") * tasks / F.col("_total")).cast("int").alias("_salts"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, by: list[str] | None = None, how: str = "inner", nulls: bool = True) -> DataFrame:
    """``left`` joined with ``right(keys, ...)`` (a row for each key at most), where no key of ``left`` goes whole to one task.

    ``counts(keys, _n)`` tells how many rows of ``left`` have each key (keys
    with few rows may be missing).  A key with more than a task's even share is
    dealt over salted tasks by a hash of ``by`` (columns that tell its rows
    apart) and of the partition, its row of ``right`` is sent to each.  The
    heavy keys are broadcast: there are at most as many as shuffle partitions.
    Nulls are equal, or match nothing without ``nulls``.
    """
    heavy = F.broadcast(heavy_keys(counts, keys).toDF(*[f"_h{i}" for i in range(len(keys))], "_salts"))

    def equal(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b) if nulls else a == b

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        same = [equal(F.col(k), F.col(f"_h{i}")) for i, k in enumerate(keys)]
        return df.join(heavy, same, "left").withColumn("_salt", salt).drop("_salts", *[f"_h{i}" for i in range(len(keys))])

    salts = F.col("_salts")
    dealt = salted(left, F.when(salts.isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(11), F.spark_partition_id(), *(by or [])), salts).cast("int")))
    sent = salted(right, F.explode(F.when(salts.isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), salts - 1))))
    sent = sent.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)} | {"_salt": "_sent"})
    same = [equal(F.col(k), F.col(f"_r{i}")) for i, k in enumerate(keys)] + [F.col("_salt") == F.col("_sent")]
    return dealt.join(sent, same, how).drop("_salt", "_sent", *[f"_r{i}" for i in range(len(keys))])


def deal_pairs(df: DataFrame, keys: list[str], member: str, payload: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """Rows of ``df`` dealt out so that every two rows with equal ``keys`` meet in one group of bounded size.

    Keys with a single row are left out.  A key of up to ``block`` rows is one
    group.  A larger one is cut by a hash of ``member`` into parts of about
    ``block`` rows, and every two parts are a group; two rows of one part meet
    in the group of that part with itself.  ``payload(member, ...)``, if given,
    is joined to what was dealt, so that it isn't sent for keys with one row.

    Returns the columns of ``df`` (and ``payload``) with ``_lo, _hi`` (parts)
    and ``_side`` (0 or 1; within ``_lo = _hi`` all are 0), partitioned and
    sorted by group.  ``df`` is read twice: cut what is dear to derive.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = spread_join(df, counts.withColumn("_parts", F.ceil(F.col("_n") / block).cast("int")).drop("_n"), keys, counts, [member])
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(5), member), F.col("_parts")).cast("int"))
    other = F.when(F.col("_parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
    rows = rows.withColumn("_other", F.explode(other))
    rows = rows.select(*df.columns, F.least("_part", "_other").alias("_lo"), F.greatest("_part", "_other").alias("_hi"), (F.col("_part") > F.col("_other")).cast("int").alias("_side"))
    if payload is not None:
        rows = rows.join(payload, member)
    return rows.repartition(*keys, "_lo", "_hi").sortWithinPartitions(*keys, "_lo", "_hi", "_side")


def by_groups(keys: list[str], work: Callable[[dict[str, np.ndarray], np.ndarray], Iterator[pa.RecordBatch]], columns: list[str], most: int = 10_000_000, held_rows: int = 20_000):
    """A function for mapInArrow over sorted groups: calls ``work(columns, starts)`` for several whole groups at a time.

    ``starts`` are the groups' first rows and the number of rows.  The sum of
    the squared group sizes of a call stays under ``most``, or it is one group.
    About ``held_rows`` rows are gathered before a call.
    """

    def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([p[c] for p in parts]) for c in columns}

    def starts_of(rows: dict[str, np.ndarray]) -> np.ndarray:
        n = len(rows[keys[0]])
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            new[1:] |= rows[k][1:] != rows[k][:-1]
        return np.append(np.flatnonzero(new), n)

    def call(rows: dict[str, np.ndarray], starts: np.ndarray):
        sizes = np.diff(starts).astype("f8")
        at = 0
        while at < len(sizes):
            cost = np.cumsum(sizes[at:] ** 2)
            to = at + max(1, int(np.searchsorted(cost, most, "right")))
            lo, hi = starts[at], starts[to]
            yield from work({c: v[lo:hi] for c, v in rows.items()}, starts[at : to + 1] - lo)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({c: as_numpy(batch.column(c)) for c in columns})
            size += batch.num_rows
            if size < held_rows:
                continue
            rows = joined(held)
            starts = starts_of(rows)
            done = int(starts[-2])  # the last group may go on
            if done:
                yield from call({c: v[:done] for c, v in rows.items()}, starts[:-1])
            held, size = [{c: v[done:] for c, v in rows.items()}], size - done
        if size:
            rows = joined(held)
            yield from call(rows, starts_of(rows))

    return run


def as_numpy(column: pa.Array) -> np.ndarray:
    """Numbers as an array; lists as an array of arrays, of whatever lengths."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    out = np.empty(len(column), object)
    for i in range(len(column)):
        out[i] = flat[at[i] : at[i + 1]]
    return out
