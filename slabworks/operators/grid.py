"""Maps joined to the cells of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A map of more cells than this is joined by a shuffle instead of being sent to every task.
BROADCAST_CELLS = 5_000_000


def attach_maps(cells: DataFrame, maps: list[tuple[str, DataFrame]], sizes: list[int] | None = None) -> DataFrame:
    """The cells with a column for the value of each map at the cell's index.

    ``maps`` has each dimension's name and cells, of the same box as the array's.
    ``sizes`` are their numbers of cells where known: a map is as long as one side of
    the box, which is checked before it is broadcast.
    """
    for k, (name, values) in enumerate(maps):
        side = values.select(F.col(f"i_{name}"), F.col("value").alias(name))
        small = sizes is not None and sizes[k] <= BROADCAST_CELLS
        cells = cells.join(F.broadcast(side) if small else side, f"i_{name}")
    return cells
