"""Numbers for the cells of a grid of chunks in which near chunks have near numbers, and boxes as ranges of them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that a box is taken apart into at most; what is left is covered with more than the box.
RANGES = 32


def layout(grid: tuple[int, ...]) -> list[tuple[int, int]]:
    """``axis, bit`` of each bit of a number, lowest first: axes take turns until a grid's extent needs no more."""
    bits = [max(0, n - 1).bit_length() for n in grid]
    if sum(bits) > 62:
        raise ValueError("too many chunks for a number")
    return [(k, b) for b in range(max(bits, default=0)) for k in reversed(range(len(grid))) if b < bits[k]]


def number(at: list[Column], grid: tuple[int, ...]) -> Column:
    """The number of the chunk at a place of the grid."""
    out = F.lit(0).cast("long")
    for place, (k, b) in enumerate(layout(grid)):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(at[k].cast("long"), b).bitwiseAND(F.lit(1)), place))
    return out


def number_of(at: tuple[int, ...], grid: tuple[int, ...]) -> int:
    return sum((at[k] >> b & 1) << place for place, (k, b) in enumerate(layout(grid)))


def ranges(low: tuple[int, ...], high: tuple[int, ...], grid: tuple[int, ...], most: int = RANGES) -> list[tuple[int, int]]:
    """First and last numbers of ranges that cover a box of chunks, ``high`` included.

    The grid is halved again and again along the number's bits; halves outside the box
    are left out, halves inside are a range. The largest halves that are neither are
    split first, until there are ``most`` ranges; halves left then are taken whole.
    """
    bits, done, partly = layout(grid), [], []

    def sort_out(size: int, first: int, box: tuple[tuple[int, int], ...]) -> None:
        if any(b < lo or a > hi for (a, b), lo, hi in zip(box, low, high, strict=True)):
            return
        inside = all(lo <= a and b <= hi for (a, b), lo, hi in zip(box, low, high, strict=True))
        (done if inside or not size else partly).append((size, first, box))

    whole = tuple((0, (1 << sum(1 for a, _ in bits if a == k)) - 1) for k in range(len(grid)))
    sort_out(len(bits), 0, whole)
    spans = lambda: joined([(f, f + (1 << s) - 1) for s, f, _ in done + partly])
    while partly and len(spans()) < most:
        size, first, box = partly.pop(max(range(len(partly)), key=lambda k: partly[k][0]))
        axis = bits[size - 1][0]
        a, b = box[axis]
        middle = (a + b) // 2
        for half, at in (((a, middle), first), ((middle + 1, b), first + (1 << size - 1))):
            sort_out(size - 1, at, (*box[:axis], half, *box[axis + 1 :]))
    return spans()


def joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, neighbours as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def chunks_in(found: list[tuple[int, int]], grid: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    """Places of the grid that ranges cover, by trying all: for small grids."""
    import itertools

    for at in itertools.product(*map(range, grid)):
        if any(a <= number_of(at, grid) <= b for a, b in found):
            yield at
