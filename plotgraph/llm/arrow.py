"""Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Text bytes that one output batch is made from, about.
BATCH_BYTES = 4_000_000


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, sliced so that ``column`` (string or binary) has about ``limit`` bytes in each."""
    for batch in batches:
        whole = batch.column(column).nbytes
        step = max(1, batch.num_rows * limit // max(whole, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def add_columns(make: Callable[[list], list[pa.Array]], column: str, names: list[str], limit: int = BATCH_BYTES):
    """A function for mapInArrow: appends columns that ``make`` derives from the values of ``column``.

    ``column`` is passed under a name of the caller's choice and stays in the output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column, limit):
            new = make(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return run
