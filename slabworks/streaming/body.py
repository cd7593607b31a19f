"""Arrays as streams of bytes: encoded by tasks, read in order a partition at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wire import encode
from ..plans.schema import ElementType
from ..session import importable


#: Boxes of up to so many cells are sorted by one task and encoded by the reader.
SMALL_CELLS = 1 << 19


def encoded_rows(cells: DataFrame, axes: list[str], kind: ElementType, place: Column | None = None) -> DataFrame:
    """``first, payload``: wire bytes of the cells in row-major order, a row for each batch, and ``place`` of its first cell.

    A range exchange on the indices gives every task a run of the array, so batches are
    encoded where they are and only bytes go to the reader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                payload = encode(batch.column(1), kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([payload], pa.binary())], ["first", "payload"])

    importable(cells.sparkSession)
    ordered = cells.orderBy(*axes) if axes else cells
    at = (F.lit(0) if place is None else place).cast("long").alias("first")
    return ordered.select(at, F.col("value").cast(kind.spark).alias("value")).mapInArrow(run, "first long, payload binary")


def run_bytes(runs: Iterator[DataFrame], kind: ElementType) -> Iterator[bytes]:
    """The wire bytes of runs that are stored in order: no exchange, no Python worker; the driver holds one DataFrame's rows."""
    for df in runs:
        table = df.select("place", F.col("values").cast(f"array<{kind.spark}>").alias("values")).toArrow().sort_by("place")
        for chunk in table.column("values").chunks:
            for k in range(len(chunk)):
                yield encode(chunk.slice(k, 1).flatten(), kind)


def array_bytes(cells: DataFrame, axes: list[str], kind: ElementType, count: int | None = None) -> Iterator[bytes]:
    """The wire bytes in order, a task's worth at a time on the driver.

    ``count`` is the number of cells, where it is known: a small box needs no exchange,
    no job that samples for it and no Python worker.
    """
    if count is not None and count <= SMALL_CELLS:
        ordered = cells.coalesce(1).sortWithinPartitions(*axes) if axes else cells
        for chunk in ordered.select(F.col("value").cast(kind.spark).alias("value")).toArrow().column(0).chunks:
            yield encode(chunk, kind)
        return
    for row in encoded_rows(cells, axes, kind).select("payload").toLocalIterator(prefetchPartitions=True):
        yield bytes(row["payload"])
