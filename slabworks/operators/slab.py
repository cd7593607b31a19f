"""The predicate of a box, as plain comparisons that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Chunks that a progression's predicate names one by one at most.
HITS = 256


def within(column: Column, start: int, count: int, size: int | None = None) -> Column | None:
    """``start <= column < start + count``; None if that is all of a dimension of ``size``."""
    if size is not None and start == 0 and count == size:
        return None
    return column == start if count == 1 else column.between(start, start + count - 1)


def stepped(column: Column, start: int, step: int) -> Column:
    """Every ``step``-th index from ``start`` on."""
    return (column.cast("long") - start) % step == 0


def covering(counts: tuple[int, ...], steps: tuple[int, ...]) -> tuple[int, ...]:
    """Counts of the box without steps from the first to the last index of each axis."""
    return tuple((c - 1) * s + 1 if c else 0 for c, s in zip(counts, steps, strict=True))


def any_of(found: list[Column]) -> Column:
    """Their disjunction as a tree of little depth."""
    while len(found) > 1:
        found = [a | b for a, b in zip(found[::2], found[1::2])] + found[len(found) - len(found) % 2 :]
    return found[0]


def chunks_hit(at: Column, start: int, count: int, step: int, n: int) -> Column | None:
    """Whether a chunk of ``n`` indices holds one of the progression; None if all between its ends do.

    Up to ``HITS`` chunks are told one by one, which reaches pages of the files; more by
    their residues: the first index that the progression could have in a chunk is in it.
    """
    if step <= n:
        return None
    if count <= HITS:
        return any_of([at == (start + k * step) // n for k in range(count)])
    between = at.between(start // n, (start + (count - 1) * step) // n)
    return between & (F.pmod(F.lit(start) - at.cast("long") * n, F.lit(step)) < n)


def pick(cells: DataFrame, axes: tuple[str, ...], starts: tuple[int, ...], steps: tuple[int, ...]) -> DataFrame:
    """Of the cells of a covering box those that the steps reach."""
    found = [stepped(F.col(f"i_{a}"), start, s) for a, start, s in zip(axes, starts, steps, strict=True) if s > 1]
    return cells.where(reduce(Column.__and__, found)) if found else cells


def index_type(size: int) -> str:
    """Spark's type of the indices of a dimension."""
    return "int" if size < 1 << 31 else "bigint"


def restrict(cells: DataFrame, axes: tuple[str, ...], starts: tuple[int, ...], counts: tuple[int, ...], shape: tuple[int, ...]) -> DataFrame:
    """The cells of a box; dimensions that are taken whole have no predicate."""
    found = [within(F.col(f"i_{a}"), s, c, n) for a, s, c, n in zip(axes, starts, counts, shape, strict=True)]
    found = [p for p in found if p is not None]
    return cells.where(reduce(Column.__and__, found)) if found else cells
