import bisect
import itertools
import random
from math import prod

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import NumpySource, cube, read_dods

from slabworks.operators import zorder
from slabworks.sources.base import Dataset
from slabworks.sources.chunks import ChunkStore, write_store


@pytest.mark.parametrize("grid", [(16, 16), (7, 13), (20,), (6, 5, 9), (1, 16)])
def test_ranges_of_every_box_cover_it_and_little_more(grid):
    numbers = {at: zorder.number_of(at, grid) for at in itertools.product(*map(range, grid))}
    assert len(set(numbers.values())) == prod(grid)
    order = sorted(numbers.values())
    boxes = list(itertools.product(*[[(i, j) for i in range(n) for j in range(i, n)] for n in grid]))
    for box in boxes if len(boxes) < 3000 else random.Random(1).sample(boxes, 3000):
        low, high = zip(*box)
        found = zorder.ranges(low, high, grid)
        assert len(found) <= zorder.RANGES
        read = sum(bisect.bisect_right(order, b) - bisect.bisect_left(order, a) for a, b in found)
        least = prod(b - a + 1 for a, b in box)
        assert least <= read <= 4 * least
        assert all(any(a <= numbers[at] <= b for a, b in found) for at in itertools.islice(itertools.product(*[range(a, b + 1) for a, b in box]), 40))


def test_numbers_in_spark(spark):
    grid = (5, 3, 9)
    rows = spark.range(5 * 3 * 9).select((F.col("id") / 27).cast("int").alias("a"), (F.col("id") / 9 % 3).cast("int").alias("b"), (F.col("id") % 9).cast("int").alias("c"))
    for r in rows.withColumn("z", zorder.number([F.col(c) for c in "abc"], grid)).collect():
        assert r["z"] == zorder.number_of((r["a"], r["b"], r["c"]), grid)


def test_boxes_in_any_axis_read_the_chunks_they_meet(spark, tmp_path):
    a = cube((60, 50), "Int32")
    write_store(str(tmp_path / "s"), NumpySource(spark, {"a": ("Int32", ("y", "x"), a)}), chunks={"a": (3, 5)})
    store = ChunkStore(spark, str(tmp_path / "s"))
    v = store.schema().find("a")
    for y, x in (((10, 15), (0, 49)), ((0, 59), (20, 24)), ((31, 33), (7, 12)), ((59, 59), (49, 49)), ((0, 59), (0, 49))):
        (found,) = read_dods(Dataset("d", store), f"a[{y[0]}:{y[1]}][{x[0]}:{x[1]}]")
        assert (found == a[y[0] : y[1] + 1, x[0] : x[1] + 1]).all()
        least = (y[1] // 3 - y[0] // 3 + 1) * (x[1] // 5 - x[0] // 5 + 1)
        met = store.met(v, (y[0], x[0]), (y[1] - y[0] + 1, x[1] - x[0] + 1))
        assert least <= met.count() <= 4 * least
    plan = store.cells("a", (31, 7), (3, 6))._jdf.queryExecution().toString()
    assert "PushedFilters: " in plan and "GreaterThanOrEqual(z," in plan
    assert store.runs("a", (0, 0), (60, 50)) is None and np.array_equal(store.cells("a", (0, 0), (60, 50)).count(), 3000)
