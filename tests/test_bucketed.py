"""Grids whose array and map are bucketed alike: equal to joining cells, and the array isn't exchanged."""

import re

import numpy as np
import pytest
from test_sources import NumpySource, cube, read_dods

from slabworks.operators import grid
from slabworks.sources.base import Dataset, Together
from slabworks.sources.chunks import ChunkStore, write_store

ARRAYS = {
    "y": ("Int64", ("y",), cube((41,), "Int64", 7) ** 2),
    "at": ("Float64", ("at",), cube((13,), "Float64") / 4),
    "a": ("Int32", ("y", "at"), cube((41, 13))),
    "b": ("Int32", ("y", "at"), cube((41, 13), "Int32", 5)),
}
QUERIES = ["a", "a[0:40][3:5]", "a[17][2:12]", "a[5:6:40][1:5:12]", "a[40][12]"]


@pytest.fixture(scope="module", params=["y", "at"])
def source(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bucketed") / "it's a store")
    write_store(path, NumpySource(spark, ARRAYS), only=["y", "at", "a"], chunk_cells=26 if request.param == "y" else 6, buckets={"a": (request.param, 4)})
    found = ChunkStore(spark, path)
    yield request.param, found
    found.close()


def cells(df):
    return sorted(map(tuple, df.select("i_y", "i_at", "value", "y", "at").collect()))


def exchanges(df):
    return re.findall(r"Exchange (?:hash|range|single)\w*", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("text", QUERIES)
def test_cells_and_maps_are_those_of_the_arrays(spark, source, text):
    want = Dataset("d", NumpySource(spark, ARRAYS), steps=True).grid(text)
    assert cells(Dataset("d", source[1], steps=True).grid(text)) == cells(want)
    (found, *maps) = read_dods(Dataset("d", source[1], steps=True), text)
    assert len(maps) == 2 and found.size == want.count()


@pytest.mark.parametrize("broadcast", [grid.BROADCAST_CELLS, 4])
def test_the_array_is_not_exchanged(spark, source, monkeypatch, broadcast):
    """Where no map is small enough to be broadcast, the bucketed axis still needs no exchange."""
    dim, store = source
    monkeypatch.setattr(grid, "BROADCAST_CELLS", broadcast)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = Dataset("d", store).grid("a")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert cells(df) == cells(Dataset("d", NumpySource(spark, ARRAYS)).grid("a"))
        if broadcast > 4:
            assert exchanges(df) == [] and "ShuffledHashJoin" in plan and plan.count("BroadcastHashJoin") == 1
        else:  # only the other axis' map makes one, of chunks and its own side
            assert len(exchanges(df)) == 2 and ("SortMergeJoin" in plan)
        plain = Dataset("d", Together(store)).grid("a")
        assert len(exchanges(plain)) == len(exchanges(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_boxes_reach_the_bucketed_files(source):
    plan = Dataset("d", source[1]).grid("a[10:12][4:5]")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_" in plan and "Bucketed: true" in plan


def test_stores_open_again_and_errors(spark, source, tmp_path):
    dim, store = source
    again = ChunkStore(spark, store.path)
    again.close()
    assert Dataset("d", again).grid("a").count() == 41 * 13
    assert spark.read.parquet(f"{store.path}/variable=a").count() == again.rows(again.schema().find("a")).count()
    with pytest.raises(ValueError, match="a isn't a grid over z"):
        write_store(str(tmp_path / "x"), NumpySource(spark, ARRAYS), buckets={"a": ("z", 4)})
    with pytest.raises(ValueError, match="cut in two ways"):
        write_store(str(tmp_path / "x"), NumpySource(spark, ARRAYS), chunks={"a": (4, 4), "b": (5, 4)}, buckets={"a": ("y", 4), "b": ("y", 4)})
    with pytest.raises(ValueError, match="two numbers"):
        write_store(str(tmp_path / "x"), NumpySource(spark, ARRAYS), buckets={"a": ("y", 4), "b": ("y", 8)})


def test_empty_axes(spark, tmp_path):
    arrays = {"y": ("Int64", ("y",), np.zeros(0, "i8")), "x": ("Int64", ("x",), np.arange(3)), "a": ("Int32", ("y", "x"), np.zeros((0, 3), "i4"))}
    write_store(str(tmp_path / "s"), NumpySource(spark, arrays), buckets={"a": ("y", 2)})
    with Dataset("d", ChunkStore(spark, str(tmp_path / "s"))) as d:
        assert d.grid("a").count() == 0
