"""Boxes with steps: off by default, equal to numpy's slices, and only chunks with a cell are taken apart."""

import itertools

import numpy as np
import pytest
from test_sources import NumpySource, cube, read_dods

from slabworks.operators import slab
from slabworks.plans.schema import TYPES, BindError, Schema, Variable
from slabworks.sources.base import Dataset, Together
from slabworks.sources.chunks import ChunkStore, write_store
from slabworks.streaming import segments


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    arrays = {"y": ("Int64", ("y",), cube((61,), "Int64", 100)), "x": ("Int16", ("x",), cube((23,), "Int16")), "a": ("Int32", ("y", "x"), cube((61, 23)))}
    root = str(tmp_path_factory.mktemp("strides"))
    write_store(f"{root}/plain", NumpySource(spark, arrays), chunk_cells=46)
    write_store(f"{root}/numbered", NumpySource(spark, arrays), chunks={"a": (4, 5)})
    return {name: ChunkStore(spark, f"{root}/{name}") for name in ("plain", "numbered")} | {"model": NumpySource(spark, arrays)}, arrays["a"][2]


SLICES = [((0, 7, 60), (0, 1, 22)), ((5, 13, 59), (2, 6, 22)), ((3, 1, 9), (1, 21, 22)), ((60, 5, 60), (0, 22, 22)), ((1, 60, 60), (7, 9, 8 + 7))]


@pytest.mark.parametrize("name", ["plain", "numbered", "model"])
@pytest.mark.parametrize("y, x", SLICES)
def test_slices_are_those_of_numpy(stores, name, y, x):
    sources, a = stores
    text = "a" + "".join(f"[{first}:{step}:{last}]" for first, step, last in (y, x))
    (found, *maps) = read_dods(Dataset("d", sources[name], steps=True), text)
    at = tuple(slice(first, last + 1, step) for first, step, last in (y, x))
    assert (found == a[at]).all() and found.shape == a[at].shape
    assert (maps[0] == np.arange(100, 161)[at[0]]).all() and (maps[1] == np.arange(23)[at[1]]).all()


@pytest.mark.parametrize("most", [slab.HITS, 1])
def test_only_chunks_with_a_cell_are_taken_apart(stores, monkeypatch, most):
    monkeypatch.setattr(slab, "HITS", most)
    store, a = stores[0]["numbered"], stores[1]
    v = store.schema().find("a")
    for y, x in itertools.product([(0, 61, 1), (2, 8, 7), (1, 3, 29), (59, 2, 1), (7, 4, 4)], [(0, 23, 1), (1, 4, 6), (22, 1, 1), (3, 2, 19)]):
        starts, counts, steps = zip(y, x)
        places = itertools.product(*[[(s + k * step) // n for k in range(c)] for s, c, step, n in zip(starts, counts, steps, (4, 5))])
        assert {(r["c_0"], r["c_1"]) for r in store.hit(v, starts, counts, steps).select("c_0", "c_1").collect()} == set(places)
        at = tuple(slice(s, s + (c - 1) * step + 1, step) for s, c, step in zip(starts, counts, steps))
        found = {(r["i_y"], r["i_x"], r["value"]) for r in store.strided("a", starts, counts, steps).collect()}
        assert found == {(i, j, int(a[i, j])) for i in range(61)[at[0]] for j in range(23)[at[1]]}


def test_progressions_reach_the_scan(stores):
    store = stores[0]["plain"]
    plan = store.strided("a", (1, 0), (3, 23), (29, 1))._jdf.queryExecution().toString()
    assert "EqualTo(c_0,0)" in plan and "EqualTo(c_0,15)" in plan and "EqualTo(c_0,29)" in plan


def test_steps_are_refused_by_default_and_checked():
    s = Schema("d", [Variable("a", TYPES["Int32"], ("y", "x"), (10, 4))])
    d = Dataset("d", Together(NumpySource(None, {"a": ("Int32", ("y", "x"), cube((10, 4)))})))
    with pytest.raises(BindError, match="steps aren't supported"):
        d.bind("a[0:2:4][1]")
    with pytest.raises(BindError, match="step of 0"):
        s.bind(d.terms("a[0:0:4][1]"), steps=True)
    with pytest.raises(BindError, match="past its dimension"):
        s.bind(d.terms("a[0:7:10][1]"), steps=True)
    assert s.bind(d.terms("a[0:3:8]"), steps=True).parts[0].leaves[0].counts == (3, 4)
    assert s.bind(d.terms("a[1:2:7][1:1:2]"), steps=True).parts[0].leaves[0].steps == (2, 1)
    assert s.bind(d.terms("a[1:1:7][3:9:3]"), steps=True).parts[0].leaves[0].steps is None
    assert "a[y = 4][x = 1]" in str(s.bind(d.terms("a[1:2:7][3]"), steps=True))


def test_grids_and_segments_with_steps(spark, stores, tmp_path):
    sources, a = stores
    d = Dataset("d", sources["plain"], steps=True)
    rows = d.grid("a[4:9:60][2:10:22]").collect()
    assert {(r["i_y"], r["i_x"], r["value"], r["y"], r["x"]) for r in rows} == {(i, j, int(a[i, j]), 100 + i, j) for i in range(4, 61, 9) for j in (2, 12, 22)}
    path = str(tmp_path / "response")
    segments.write_dods(d, "a[4:9:60][2:10:22]", path)
    length, body = d.dods("a[4:9:60][2:10:22]")
    assert b"".join(segments.read_dods(path)) == b"".join(body)
