import json
import os
import re
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slabworks.config import load
from slabworks.functions.attributes import Attribute
from slabworks.functions.wire import wire_dtype
from slabworks.operators.catalog import Catalog, NotListed, list_folder
from slabworks.operators.join_existing import Piece, first_member, joined_range, pieces
from slabworks.plans.schema import TYPES, BindError, Schema, Variable
from slabworks.server import Service, serve
from slabworks.sources.aggregate import DescriptionError, JoinedSource, read_description
from slabworks.sources.base import ArraySource, Dataset, Stale
from slabworks.sources.chunks import ChunkStore, write_store
from slabworks.sources.tables import NotDense, TableSource
from slabworks.sources.scan import dataset_files, open_dataset, open_folder


class NumpySource(ArraySource):
    """The model: whole arrays in memory."""

    def __init__(self, spark, arrays, attributes=None):
        self.spark, self.arrays, self.changed, self._attributes = spark, arrays, 0, attributes or {None: []}

    def schema(self):
        return Schema("", [Variable(n, TYPES[t], d, a.shape) for n, (t, d, a) in self.arrays.items()])

    def attributes(self):
        return self._attributes

    def stamp(self):
        return self.changed

    def cells(self, name, starts, counts):
        kind, _, a = self.arrays[name]
        v = self.schema().find(name)
        rows = [(*(int(i) for i in at), a[at].item()) for at in np.ndindex(*a.shape) if all(s <= i < s + c for i, s, c in zip(at, starts, counts))]
        columns = ", ".join([*(f"`i_{x}` int" for x in v.axes), f"value {'bigint' if kind == 'UInt64' else TYPES[kind].spark}"])
        return self.spark.createDataFrame(rows, columns).withColumn("value", F.col("value").cast(TYPES[kind].spark))


def cube(shape, kind="Int32", first=0):
    return (np.arange(np.prod(shape, dtype=int)).reshape(shape) + first).astype(TYPES[kind].numpy)


def read_dods(dataset, text):
    """Arrays of a data response, decoded by the schema it starts with."""
    length, body = dataset.dods(text)
    data = b"".join(body)
    assert len(data) == length
    head, _, rest = data.partition(b"\n\nData:\n")
    answer = dataset.bind(text)
    assert head.decode() == str(answer)
    out = []
    for leaf in answer.leaves:
        if not leaf.scalar:
            assert rest[:8] == leaf.cells.to_bytes(4, "big") * 2
            rest = rest[8:]
        n = leaf.cells * leaf.type.wire
        out.append(np.frombuffer(rest[:n], wire_dtype(leaf.type)).reshape(leaf.counts))
        rest = rest[n:]
    assert not rest
    return out


@pytest.fixture(scope="module")
def months(spark):
    def month(first, n):
        return NumpySource(
            spark,
            {
                "time": ("Int32", ("time",), cube((n,), first=first)),
                "y": ("Float32", ("y",), cube((3,), "Float32")),
                "x": ("Float64", ("x",), cube((4,), "Float64")),
                "P": ("Float32", ("time", "y", "x"), cube((n, 3, 4), "Float32", 1000 * first)),
                "mask": ("Int16", ("y", "x"), cube((3, 4), "Int16", -6)),
            },
            {None: [Attribute("title", "String", ("months",))], "P": [Attribute("units", "String", ("mm",))]},
        )

    return month(0, 31), month(31, 28)


@pytest.mark.parametrize("kind", list(TYPES))
def test_every_type_comes_back_from_the_wire(spark, kind):
    a = cube((2, 3), kind)
    if kind == "Byte":
        a[1, 2] = 255
    if kind == "UInt64":
        a[0, 0] = 2**63 - 1
    if kind.startswith("Int"):
        a[0, 1] = -5
    (found,) = read_dods(Dataset("d", NumpySource(spark, {"a": (kind, ("y", "x"), a)})), "a")
    assert (found == a).all()


def test_four_dimensions_and_scalars(spark):
    a = cube((2, 3, 4, 5), "Int16", -60)
    d = Dataset("d", NumpySource(spark, {"a": ("Int16", tuple("tzyx"), a), "one": ("Float64", (), np.array(2.5))}))
    found = read_dods(d, "a[1][0:1][2],one")
    assert (found[0] == a[1:2, 0:2, 2:3]).all() and found[1] == 2.5
    assert len(read_dods(d, None)) == 2


def test_store_keeps_values_attributes_and_order(spark, months, tmp_path):
    path = str(tmp_path / "jan.slab")
    write_store(path, months[0], chunk_cells=20)
    d = open_dataset(spark, path)
    assert d.das() == Dataset("jan.slab", months[0]).das() and d.dds() == Dataset("jan.slab", months[0]).dds()
    p, t, y, x = read_dods(d, "P[3:17][1:2]")
    assert (p == months[0].arrays["P"][2][3:18, 1:3]).all() and (t == np.arange(3, 18)).all() and len(y) == 2 and len(x) == 4
    plan = d.leaf(d.bind("P[3:4]").parts[0].leaves[0])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_0)" in plan


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_boxes_of_random_stores_match_slices(spark, tmp_path_factory, data):
    shape = tuple(data.draw(st.lists(st.integers(1, 6), min_size=1, max_size=3)))
    a, dims = cube(shape), tuple("zyx"[-len(shape) :])
    path = str(tmp_path_factory.mktemp("store"))
    write_store(path, NumpySource(spark, {"a": ("Int32", dims, a)}), chunk_cells=data.draw(st.integers(1, 30)))
    bounds = [sorted((data.draw(st.integers(0, n - 1)), data.draw(st.integers(0, n - 1)))) for n in shape[: data.draw(st.integers(1, len(shape)))]]
    text = "a" + "".join(f"[{lo}:{hi}]" for lo, hi in bounds)
    (found, *_) = read_dods(Dataset("d", ChunkStore(spark, path)), text)
    assert (found == a[tuple(slice(lo, hi + 1) for lo, hi in bounds)]).all()


def test_joined_months(spark, months):
    jan, feb = months
    d = Dataset("year", JoinedSource([feb, jan], "time"))
    assert d.source.sizes == [31, 28] and d.source.ranks == [0.0, 31.0]
    assert "P[time = 59][y = 3][x = 4]" in d.dds("P") and "mm" in d.das()
    p, t, *_ = read_dods(d, "P[3:40]")
    assert (p[:28] == jan.arrays["P"][2][3:]).all() and (p[28:] == feb.arrays["P"][2][:10]).all() and (t == np.arange(3, 41)).all()
    (t,) = read_dods(d, "time")
    assert t.tobytes() == np.arange(59, dtype=">i4").tobytes()
    (m,) = read_dods(d, "mask[1]")[:1]
    assert (m == jan.arrays["mask"][2][1:2]).all()
    (late,) = read_dods(d, "P.P[35:36][0][1:2]")
    assert (late == feb.arrays["P"][2][4:6, :1, 1:3]).all()
    with pytest.raises(BindError):
        d.bind("P[0:59]")


def test_members_out_of_order_overlap_and_errors(spark):
    def member(values):
        a = np.array(values, np.int32)
        return NumpySource(spark, {"t": ("Int32", ("t",), a), "v": ("Int32", ("t",), a * 10)})

    d = Dataset("d", JoinedSource([member([5, 6, 7, 8, 9]), member([0, 1, 2]), member([2, 3, 4, 5])], "t"))
    want = [0, 1, 2, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    for lo, hi in ((0, 11), (1, 2), (2, 8), (4, 7), (9, 9)):
        v, = read_dods(d, f"v[{lo}:{hi}]")
        assert (v == np.array(want[lo : hi + 1]) * 10).all()
        t, = read_dods(d, f"t[{lo}:{hi}]")
        assert (t == want[lo : hi + 1]).all()
    with pytest.raises(ValueError):
        JoinedSource([], "t")
    with pytest.raises(ValueError):
        JoinedSource([member([])], "t")
    assert pieces([5, 3, 4], 3, 6) == [Piece(0, 3, 2, 0), Piece(1, 0, 3, 5), Piece(2, 0, 1, 8)] and pieces([5, 3], 5, 0) == []


NCML = '<?xml version="1.0" encoding="UTF-8"?>\n<netcdf xmlns="http://www.unidata.ucar.edu/namespaces/netcdf/ncml-2.2">{}</netcdf>'


def test_descriptions_and_folders(spark, months, tmp_path, caplog):
    for name, source in zip(("jan", "feb"), months):
        write_store(str(tmp_path / "data" / f"{name}.slab"), source, only=["time", "P"])
    data = tmp_path / "data"
    (data / "sub" / ".hidden").mkdir(parents=True)
    join = '<aggregation dimName="time" type="joinExisting">{}</aggregation>'
    (data / "agg.ncml").write_text(NCML.format(join.format('<netcdf location="feb.slab"/><netcdf/><other/><netcdf location="jan.slab"/>')))
    (data / "sub" / "scan.ncml").write_text(NCML.format(join.format('<scan location=".." suffix=".slab" ignore="nothing"/>')))
    (data / "sub" / "broken.ncml").write_text(NCML.format("<variable/>"))
    (data / "sub" / "notes.txt").write_text("x")
    (data / "sub" / ".hidden" / "a.ncml").write_text("x")
    (data / ".b.ncml").write_text("x")
    (data / "a.NC").write_text("x")
    keys = [k for k, _ in dataset_files(str(data))]
    assert keys == ["agg.ncml", "feb.slab", "jan.slab", "sub/broken.ncml", "sub/scan.ncml"]
    catalog = open_folder(spark, str(data))
    assert sorted(catalog.paths()) == ["agg.ncml", "feb.slab", "jan.slab", "sub/scan.ncml"] and "broken" in caplog.text
    for key in ("agg.ncml", "sub/scan.ncml"):
        assert f"time = 59" in catalog.get(key).dds("time") and catalog.get(key).dds().endswith(f"}} {key};")
        (t,) = read_dods(catalog.get(key), "time[30:32]")
        assert t.tolist() == [30, 31, 32]
    for bad in ("", "<variable/>", '<aggregation type="union" dimName="t"/>', '<aggregation dimName="t"/>', '<aggregation type="joinExisting"/>', join.format('<scan location="."/>')):
        (tmp_path / "bad.ncml").write_text(NCML.format(bad))
        with pytest.raises(DescriptionError):
            read_description(str(tmp_path / "bad.ncml"))
    os.utime(data / "agg.ncml", ns=(1, 1))
    with pytest.raises(Stale):
        catalog.get("agg.ncml").dods("time")[1].__class__ and list(catalog.get("agg.ncml").dods("time")[1])


def test_changes_and_malformed_queries(spark, months):
    d = Dataset("d", months[0])
    assert d.bind("P[x", on_malformed="all") == d.bind()
    with pytest.raises(ValueError):
        d.bind("P[x")
    with pytest.raises(FileNotFoundError):
        d.raw()
    months[0].changed += 1
    assert d.dds() and d.das()
    with pytest.raises(Stale):
        d.cells("P")
    months[0].changed -= 1


def test_grid_cells_have_map_values(spark, months):
    rows = Dataset("d", months[1]).grid("P[0:1][2]").orderBy("i_time", "i_y", "i_x").collect()
    assert len(rows) == 8 and [(r["time"], r["y"], r["x"]) for r in rows[:2]] == [(31, 2.0, 0.0), (31, 2.0, 1.0)] and rows[0]["value"] == 31008.0


PATHS = ["sea.h5", "air.h5", "north/ice.nc", "north/snow.nc", "north/deep/cold.nc", "south/sun.nc", "west/far/wind.nc"]


def test_catalog(spark):
    c = Catalog(PATHS)
    assert c.folder("north/") == c.folder("north") == (["deep"], ["ice.nc", "snow.nc"])
    assert c.folder("west/") == (["far"], [])
    assert c.folder() == (["north", "south", "west"], ["air.h5", "sea.h5"])
    for missing in ("sea.h5", "north/none.nc", "east/", "nor"):
        with pytest.raises(NotListed):
            c.folder(missing)
    with pytest.raises(NotListed):
        c.get("nothing")
    keys = spark.createDataFrame([(p,) for p in [*PATHS, PATHS[0]]], "key string")
    for folder in ("", "north", "west/", "none"):
        folders, names = c.folder(folder) if folder != "none" else ([], [])
        assert sorted(map(tuple, list_folder(keys, folder).collect())) == sorted([("folder", f) for f in folders] + [("dataset", n) for n in names])


def test_service_routes(spark, months, tmp_path):
    d = Dataset("late/jan.nc", months[0])
    server = serve(spark, Catalog({"late/jan.nc": d}), "127.0.0.1", 0, "/root")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", headers=headers)) as r:
                return r.status, r.read(), dict(r.headers)
        except urllib.error.HTTPError as e:
            return e.code, e.read(), {}

    assert b"1 datasets" in get("/")[1]
    for path in ("/data", "/data/", "/data/late", "/data/late/"):
        assert get(path)[0] == 200
    assert b'href="/root/data/late/jan.nc.dds"' in get("/data/late")[1]
    assert json.loads(get("/data", Accept="application/json")[1]) == ["late/jan.nc"]
    for path in ("/data/late/none.nc", "/data/missing/", "/other", "/data/late/jan.nc", "/data/late/none.nc.das"):
        assert get(path)[0] == 404
    assert get("/data/late/jan.nc.das?ignored[")[1].decode() == d.das()
    assert get("/data/late/jan.nc.dds")[1].decode() == d.dds()
    assert get("/data/late/jan.nc.dds?P%5B0:1%5D")[1].decode() == d.dds("P[0:1]")
    assert get("/data/late/jan.nc.dds?P[x")[1].decode() == d.dds()
    assert get("/data/late/jan.nc.dds?P[0:2:4]")[0] == get("/data/late/jan.nc.dods?P[99]")[0] == 400
    status, body, headers = get("/data/late/jan.nc.dods?P.P[1:2][0]")
    length, want = d.dods("P.P[1:2][0]")
    assert status == 200 and body == b"".join(want) and headers["Content-Length"] == str(length) and headers["Content-Description"] == "dods-data"
    server.shutdown()
    assert Service(Catalog({})).reply("/data").status == 404


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert load([]).host_port == ("127.0.0.1", 8001) and load([]).data == "data/"
    (tmp_path / "slabworks.toml").write_text('data = "d/"\naddress = "0.0.0.0:80"\nroot_url = "/x"\n[db]\npath = "i"\n')
    c = load([])
    assert (c.data, c.address, c.root_url, c.index) == ("d/", "0.0.0.0:80", "/x", "i")
    c = load(["-a", "[::1]:9", "--root-url", "/y", "one", "two"])
    assert (c.data, c.host_port, c.root_url) == ("one", ("::1", 9), "/y")
    with pytest.raises(SystemExit):
        load(["-h"])


def test_large_boxes_are_encoded_by_tasks(spark, months, monkeypatch):
    from slabworks.streaming import body

    d = Dataset("d", months[0])
    small = b"".join(d.dods("P[2:20]")[1])
    monkeypatch.setattr(body, "SMALL_CELLS", 10)
    assert b"".join(d.dods("P[2:20]")[1]) == small


def test_an_index_with_gaps_or_repeats_is_refused(spark):
    def table(*index):
        return spark.createDataFrame([(i, float(k)) for k, i in enumerate(index)], "n long, v double")

    assert TableSource(table(2, 0, 1), "t", "n").length == 3 and TableSource(table(), "t", "n").length == 0
    for bad in ((0, 2), (1, 2), (0, 1, 1, 3), (0, None), (0, 1, 1), (0, 0, 3, 3)):
        with pytest.raises(NotDense):
            TableSource(table(*bad), "t", "n")


def test_changes_and_failures_are_told_by_the_status(spark, months):
    class Failing(NumpySource):
        def cells(self, name, starts, counts):
            return super().cells(name, starts, counts).withColumn("value", F.raise_error(F.lit("lost")).cast("int"))

    failing = Failing(spark, months[0].arrays)
    service = Service(Catalog({"a": Dataset("a", months[0]), "b": Dataset("b", failing)}))
    assert service.reply("/data/b.dods", "time").status == 500
    months[0].changed += 1
    try:
        assert service.reply("/data/a.dods", "time").status == 503
    finally:
        months[0].changed -= 1
    reply = service.reply("/data/a.dods", "time[0:3]")
    assert reply.status == 200 and len(b"".join(reply.body)) == int(reply.headers["Content-Length"])


def test_kept_data_is_given_back(spark, months):
    source = JoinedSource(list(months), "time")
    with Dataset("d", source) as d:
        kept = d.source.coordinate
        assert kept.count() == 1 and kept.first()["values"] is None and d.cells("time")[0][1].count() == 59
        path = d.source._kept.removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_ranges_of_joined_tables_read_only_their_members(spark, tmp_path):
    rows = [(m, k, float(100 * m + k)) for m, n in ((3, 5), (1, 4), (2, 6)) for k in range(n)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "m int, k int, c double").write.partitionBy("m").parquet(path)
    table = spark.read.parquet(path)
    whole = sorted((r["m"], r["k"]) for r in table.collect())
    for start, count in ((0, 15), (3, 4), (4, 6), (14, 1), (0, 0), (9, 3)):
        found = joined_range(table, F.col("m"), F.col("c"), "k", start, count, "i")
        assert sorted((r["i"], r["m"], r["k"]) for r in found.collect()) == [(i, *whole[i]) for i in range(start, start + count)]
    only = joined_range(table, F.col("m"), F.col("c"), "k", 4, 6, "i")
    assert "i" in only.columns
    first = first_member(table, F.col("m"), F.col("c"), "k")
    assert {r["m"] for r in first.collect()} == {1} and first.count() == 4 and first_member(table.limit(0), F.col("m"), F.col("c"), "k").count() == 0


@pytest.mark.parametrize("run", [1, 30, 1 << 20])
def test_chunks_in_order_are_streamed_as_they_lie(spark, months, tmp_path, monkeypatch, run):
    from slabworks.sources import chunks

    monkeypatch.setattr(chunks, "RUN_CELLS", run)
    for name, source in zip(("jan", "feb"), months):
        write_store(str(tmp_path / f"{name}.slab"), source, chunk_cells=40)  # three rows of the outermost dimension
    jan, feb = (ChunkStore(spark, str(tmp_path / f"{n}.slab")) for n in ("jan", "feb"))
    d, plain = Dataset("d", JoinedSource([feb, jan], "time")), Dataset("d", JoinedSource(list(months), "time"))
    assert d.source.runs("P", (3, 0, 0), (40, 3, 4)) is not None and d.source.runs("P", (3, 0, 0), (40, 3, 2)) is None
    for text in ("P", "P[3:40]", "P.P[30:31]", "P.P[58]", "P[2:9][1]", "time[5:33]", "mask", "mask[1:2]", None):
        assert b"".join(d.dods(text)[1]) == b"".join(plain.dods(text)[1])
    assert "Exchange" not in next(jan.runs("P", (3, 0, 0), (5, 3, 4)))._jdf.queryExecution().executedPlan().toString()
