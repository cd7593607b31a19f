"""Coordinates as segments: regular stretches are a first value and a step, others stay as values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable

#: Values of a segment at most.
LONGEST = 65_536
_STEPPED = ("smallint", "int", "bigint", "float", "double")


def _at(first: Column, step: Column, k: Column, kind: str) -> Column:
    """The value ``k`` steps after the first; null where the type has no such number."""
    wide = "bigint" if kind in ("smallint", "int") else kind
    return F.try_add(first.cast(wide), F.try_multiply(k.cast(wide), step.cast(wide))).cast(kind)


def _told(values: np.ndarray) -> object | None:
    """The step that gives back each value exactly from the first, if there is one."""
    first, step = values[0].item(), (values[1].item() - values[0].item()) if len(values) > 1 else 0
    k = np.arange(len(values))
    if values.dtype.kind == "i":
        info = np.iinfo(values.dtype)
        if not (abs(step) * (len(values) - 1) <= info.max and info.min <= first + step * (len(values) - 1) <= info.max):
            return None
        made = (first + k * step).astype(values.dtype)
    else:
        with np.errstate(all="ignore"):
            step = values.dtype.type(values[1] - values[0]) if len(values) > 1 else values.dtype.type(0)
            made = values[0] + k.astype(values.dtype) * step
            step = step.item()
    return step if made.tobytes() == values.tobytes() else None  # by bytes: -0.0 isn't 0.0


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        steps = [_told(row.values.to_numpy(zero_copy_only=False)) for row in batch.column(1)]
        kind = batch.schema.field(1).type.value_type
        payload = batch.column(1)
        rows = [batch.column(0), pc.list_value_length(payload).cast(pa.int64()), pc.list_element(payload, 0), pa.array(steps, kind), pc.if_else(pa.array([x is None for x in steps]), payload, pa.scalar(None, payload.type))]
        yield pa.RecordBatch.from_arrays(rows, ["at", "n", "first", "step", "values"])


def segments(stretches: DataFrame, kind: str) -> DataFrame:
    """``at, n, first, step, values`` of ``at, payload``: the index of a stretch's first value, and its values.

    A stretch whose values are all told by the first and the step between the first two
    has no ``values``; a step is taken only if each value comes back from it exactly.
    """
    importable(stretches.sparkSession)
    rows = stretches.where(F.size("payload") > 0).select(F.col("at").cast("long").alias("at"), F.col("payload").cast(f"array<{kind}>").alias("payload"))
    if kind not in _STEPPED:
        return rows.select("at", F.size("payload").cast("long").alias("n"), F.get("payload", F.lit(0)).alias("first"), F.lit(None).cast(kind).alias("step"), F.col("payload").alias("values"))
    return rows.mapInArrow(_segment_rows, f"at long, n long, first {kind}, step {kind}, values array<{kind}>")


def segment_cells(stored: DataFrame, axis: str, index: str, kind: str, start: int, count: int) -> DataFrame:
    """``axis, value`` of a range of the coordinate, from the segments that it meets."""
    low, high = F.greatest(F.col("at"), F.lit(start)), F.least(F.col("at") + F.col("n"), F.lit(start + count))
    met = stored.where((F.col("at") < start + count) & (F.col("at") + F.col("n") > start) & F.lit(count > 0))
    cells = met.select("*", F.explode(F.sequence(low, high - 1)).alias("i"))
    k = (F.col("i") - F.col("at")).cast("int")
    value = F.when(F.col("values").isNotNull(), F.get("values", k))
    if kind in _STEPPED:
        value = value.otherwise(_at(F.col("first"), F.col("step"), k, kind))
    return cells.select(F.col("i").cast(index).alias(axis), value.cast(kind).alias("value"))
