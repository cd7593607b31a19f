"""HDF5 files: written in the older form by the package, put together in the newer form here, byte by byte by the format."""

import struct
import zlib

import numpy as np
import pytest

from slabworks.sources import hdf5
from slabworks.sources.hdf5_format import File, Unsupported
from slabworks.sources.hdf5_write import Array, datatype, write_hdf5
from slabworks.sources.scan import open_dataset, open_folder
from slabworks.sources.aggregate import JoinedSource
from slabworks.sources.base import Dataset

rng = np.random.default_rng(5)
WIND = rng.normal(size=(7, 9, 11)).astype(">f4")
RAIN = rng.integers(-3000, 3000, (7, 9, 11)).astype("<i2")


def example(path, **more):
    arrays = {
        "level": Array(np.arange(7) * 10.0),
        "north": Array(np.arange(9, dtype="f4")),
        "east": Array(np.arange(11, dtype=">i4")),
        "wind": Array(WIND, ("level", "north", "east"), {"units": "m/s", "_FillValue": np.float32(-1e34), "n": np.int16(4), "r": np.array([1.5, 2.0])}, (2, 4, 5)),
        "rain": Array(RAIN, ("level", "north", "east"), {}, (3, 9, 2)),
        "flat": Array(np.arange(6, dtype="<i2").reshape(2, 3)),
        "one": Array(np.array(7, "u1")),
        "names": Array(np.array([b"ab", b"c"])),
        "away": Array(np.zeros(0)),
        **more,
    }
    write_hdf5(str(path), arrays, {"title": "example", "_NCProperties": "hidden", "wide": np.int64(3)})


def test_schema_attributes_and_cells(spark, tmp_path):
    example(tmp_path / "a.nc4")
    d = open_dataset(spark, str(tmp_path / "a.nc4"))
    assert d.dds("flat,one,wind.wind[1:2]") == "Dataset {\n    Int16 flat[flat = 2];\n    Byte one;\n    Structure {\n        Float32 wind[level = 2][north = 9][east = 11];\n    } wind;\n} a.nc4;"
    assert [p.kind for p in d.bind("wind,rain").parts] == ["grid", "grid"]
    text = d.das()
    assert 'String title "example";' in text and "hidden" not in text and "wide" not in text and "    names {" in text and "away" not in text
    assert 'String units "m/s";' in text and "Int16 n 4;" in text and "Float64 r +1.5E0, +2.0E0;" in text and "Float32 _FillValue -1.0E34;" in text
    rows = d.cells("wind.wind[1:3][2:5][10]")[0][1].collect()
    assert {tuple(r)[:3]: r["value"] for r in rows} == {(i, j, 10): WIND[i, j, 10].item() for i in (1, 2, 3) for j in (2, 3, 4, 5)}
    body = b"".join(d.dods("rain.rain[6][0:1][3:4],one")[1])
    assert body.endswith(struct.pack(">II", 4, 4) + RAIN[6, :2, 3:5].astype(">i4").tobytes()) or body.count(RAIN[6, :2, 3:5].astype(">i4").tobytes()) == 1
    assert b"".join(d.raw()) == (tmp_path / "a.nc4").read_bytes()


@pytest.mark.parametrize("kind", ["<f4", ">f4", "<f8", ">f8", "<i2", ">i2", "<i4", ">i8", "u1", "<u2", ">u4", "<u8"])
@pytest.mark.parametrize("how", [{}, {"chunk": (4, 3)}, {"chunk": (4, 3), "deflate": False}, {"chunk": (1, 1), "shuffle": False}])
def test_every_type_and_storage(tmp_path, kind, how):
    a = rng.integers(0, 120, (13, 8)).astype(kind)
    write_hdf5(str(tmp_path / "x.h5"), {"a": Array(a, **how)})
    with File(str(tmp_path / "x.h5")) as f:
        data = f.object(f.root.links["a"])
        assert data.read().dtype == a.dtype and (data.read() == a).all()
        for _ in range(10):
            lo, hi = np.sort(rng.integers(0, 13, 2)), np.sort(rng.integers(0, 8, 2))
            assert (data.read((lo[0], hi[0]), (lo[1] - lo[0], hi[1] - hi[0])) == a[lo[0] : lo[1], hi[0] : hi[1]]).all()


def test_trees_of_many_chunks_and_groups_of_many_arrays(tmp_path):
    a = np.arange(9000.0)
    write_hdf5(str(tmp_path / "x.h5"), {"long": Array(a, chunk=(2,))} | {f"v{k}": Array(np.array([k])) for k in range(60)})
    with File(str(tmp_path / "x.h5")) as f:
        assert list(f.root.links) == sorted(["long", *(f"v{k}" for k in range(60))])
        data = f.object(f.root.links["long"])
        assert (data.read() == a).all() and (data.read((4001,), (7,)) == a[4001:4008]).all()
        assert len(list(data.chunks((4001,), (7,)))) == 4
        assert f.object(f.root.links["v59"]).read().tolist() == [59]


def test_a_block_of_the_users_own_in_front(tmp_path):
    example(tmp_path / "a.h5")
    (tmp_path / "b.h5").write_bytes(b"x" * 1024 + (tmp_path / "a.h5").read_bytes())
    with File(str(tmp_path / "b.h5")) as f:
        assert (f.object(f.root.links["wind"]).read() == WIND).all()


class New:
    """A file in the newer form: superblock 2, headers 2, links and attributes in headers or in heaps."""

    def __init__(self):
        self.raw = bytearray(48)

    def add(self, piece):
        at = len(self.raw)
        self.raw += piece + b"\0" * (-len(piece) % 8)
        return at

    def header(self, messages):
        """The messages after the first in a second block."""
        def block(some):
            return b"".join(struct.pack("<BHBH", t, len(m), 0, 0) + m for t, m in some)

        tail = b"OCHK" + block(messages[1:]) + b"sum!"
        at = self.add(tail)
        first = block([messages[0], (16, struct.pack("<QQ", at, len(tail)))])
        return self.add(b"OHDR\x02" + bytes([0x04 | 0x20 | 0x10 | 1]) + bytes(16) + struct.pack("<HH", 8, 6) + struct.pack("<H", len(first)) + first + b"sum!")

    def heap(self, objects, indirect):
        """A fractal heap of the objects, in one block or in blocks of 512 bytes under another; ids as the index has them."""
        start, width, place = 512, 4, 4
        head = 5 + 8 + place
        blocks, ids = [bytearray(head)], []
        for o in objects:
            if len(blocks[-1]) + len(o) > start:
                blocks[-1] += bytes(start - len(blocks[-1]))
                blocks.append(bytearray(head))
            ids.append(b"\0" + struct.pack("<IH", (len(blocks) - 1) * start + len(blocks[-1]), len(o)))
            blocks[-1] += o
        for k, b in enumerate(blocks):
            b[:head] = b"FHDB\0" + struct.pack("<QI", 0, k * start)
            b += bytes(start - len(b))
        at = [self.add(bytes(b)) for b in blocks]
        assert indirect == (len(blocks) > 1) and len(blocks) <= 2 * width
        rows = 2 if indirect else 0
        root = self.add(b"FHIB\0" + struct.pack("<QI", 0, 0) + struct.pack("<8Q", *at, *[2**64 - 1] * (8 - len(at)))) if indirect else at[0]
        header = b"FRHP\0" + struct.pack("<HHBI", 7, 0, 0, 4096) + struct.pack("<QQQQ", 0, 2**64 - 1, 0, 2**64 - 1) + bytes(64)
        header += struct.pack("<HQQHHQH", width, start, 65536, 32, 1, root, rows) + b"sum!"
        return self.add(header), ids

    def index(self, form, records):
        """Of depth 1 where there are more records than three."""
        size, node = len(records[0]), 2048
        leaf = lambda some: self.add((b"BTLF\0" + bytes([form]) + b"".join(some)).ljust(node, b"\0"))
        if len(records) <= 3:
            root, depth, count = leaf(records), 0, len(records)
        else:
            parts, own = [records[0:2], records[3:]], [records[2]]
            root, depth, count = self.add((b"BTIN\0" + bytes([form]) + b"".join(own) + b"".join(struct.pack("<QB", leaf(p), len(p)) for p in parts)).ljust(node, b"\0")), 1, 1
        return self.add(b"BTHD\0" + struct.pack("<BIHHBB", form, node, size, depth, 98, 40) + struct.pack("<QHQ", root, count, len(records)) + b"sum!")

    def close(self, path, root):
        head = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, 2**64 - 1, len(self.raw), root) + b"sum!"
        self.raw[: len(head)] = head
        path.write_bytes(bytes(self.raw))


def space(*shape):
    return struct.pack("<BBBB", 2, len(shape), 0, 1) + struct.pack(f"<{len(shape)}Q", *shape)


def new_attribute(name, a):
    kind, about = datatype(a.dtype), space(*a.shape)
    return struct.pack("<BBHHHB", 3, 0, len(name) + 1, len(kind), len(about), 0) + name.encode() + b"\0" + kind + about + a.tobytes()


def new_link(name, order, at):
    return struct.pack("<BBQBB", 1, 0x04 | 0x10, order, 1, len(name)) + name.encode() + struct.pack("<Q", at)


@pytest.mark.parametrize("n", [2, 3, 40])
def test_the_newer_form(tmp_path, n):
    """Compact links for two arrays, a heap of one block for three and of several for 40, with an index of one and of two levels."""
    out, a = New(), np.arange(60, dtype="<f4").reshape(5, 12)
    raw = zlib.compress(np.frombuffer(a.tobytes(), np.uint8).reshape(-1, 4).T.tobytes()) + b"sum4"
    filters = struct.pack("<BB", 2, 3) + struct.pack("<HHHI", 2, 0, 1, 4) + struct.pack("<HHHI", 1, 0, 1, 6) + struct.pack("<HHH", 3, 0, 0)
    single = struct.pack("<BBBBB", 4, 2, 2, 3, 1) + bytes([5, 12, 4]) + struct.pack("<BQIQ", 1, len(raw), 0, out.add(raw))
    attributes = [new_attribute("k", np.array(5, "<i4")), new_attribute("text", np.array(b"hello"))]
    first = out.header([(1, space(5, 12)), (3, datatype(a.dtype)), (11, filters), (8, single), *[(12, x) for x in attributes]])
    many = [new_attribute(f"a{k:02d}", np.array(k, "<i2")) for k in range(n)]
    heap, ids = out.heap(many, n > 20)
    tree = out.index(8, [i + b"\0" + struct.pack("<BII", 0, n - k, 0) for k, i in enumerate(ids)])
    compact = struct.pack("<BBH", 3, 0, 12) + np.array([3, 1, 2], "<i4").tobytes()
    others = [out.header([(1, space(3)), (3, datatype(np.dtype("<i4"))), (8, compact), (21, struct.pack("<BBHQQ", 0, 1, n, heap, tree))]) for _ in range(n - 1)]
    links = [new_link("z-first", 0, first), *(new_link(f"b{k:02d}", k + 1, at) for k, at in enumerate(others))]
    if n == 2:
        root = out.header([(2, struct.pack("<BBQQQ", 0, 1, n, 2**64 - 1, 2**64 - 1)), *[(6, x) for x in links]])
    else:
        heap, ids = out.heap(links, n > 20)
        root = out.header([(2, struct.pack("<BBQQQ", 0, 1, n, heap, out.index(5, [struct.pack("<I", k) + i for k, i in enumerate(ids)][::-1]))), (12, attributes[1])])
    out.close(tmp_path / "new.h5", root)
    with File(str(tmp_path / "new.h5")) as f:
        assert list(f.root.links) == ["z-first", *(f"b{k:02d}" for k in range(n - 1))]
        data = f.object(first)
        assert (data.read((1, 2), (3, 4)) == a[1:4, 2:6]).all() and data.attributes["k"] == 5 and data.attributes["text"] == b"hello"
        other = f.object(f.root.links["b00"])
        assert other.read().tolist() == [3, 1, 2]
        assert list(other.attributes) == [f"a{k:02d}" for k in reversed(range(n))] and all(int(v) == int(k[1:]) for k, v in other.attributes.items())


def test_members_of_files(spark, tmp_path):
    for name, first, count in (("b.nc", 0, 31), ("a.nc", 31, 28)):
        t = np.arange(first, first + count, dtype="f8")
        values = np.add.outer(t * 10, np.arange(4)).astype("f4")
        write_hdf5(str(tmp_path / name), {"time": Array(t), "x": Array(np.arange(4, dtype="i4")), "v": Array(values, ("time", "x"), chunk=(5, 4)), "mask": Array(np.arange(4, dtype="i2") + first, ("x",))})
    (tmp_path / "year.ncml").write_text('<netcdf xmlns="x"><aggregation dimName="time" type="joinExisting"><scan location="." suffix=".nc"/></aggregation></netcdf>')
    catalog = open_folder(spark, str(tmp_path))
    assert sorted(catalog.paths()) == ["a.nc", "b.nc", "year.ncml"]
    with catalog.get("year.ncml") as d:
        assert "v[time = 59][x = 4]" in d.dds("v.v")
        rows = {tuple(r)[:2]: r["value"] for r in d.cells("v.v[29:33][1:2]")[0][1].collect()}
        assert rows == {(t, x): t * 10.0 + x for t in range(29, 34) for x in (1, 2)}
        assert [r["value"] for r in d.cells("mask")[0][1].orderBy("i_x").collect()] == [0, 1, 2, 3]


def test_runs_of_the_outer_dimension(monkeypatch):
    monkeypatch.setattr(hdf5, "PARTITION_CELLS", 8)
    reader = hdf5.SlabReader({"path": "p", "variable": "v", "starts": "3,0", "counts": "5,4"}, None)
    assert [(r.start, r.count) for r in reader.partitions()] == [(3, 2), (5, 2), (7, 1)]


def test_what_is_no_file_of_the_format(spark, tmp_path):
    for raw in (b"", b"text", b"\x89HDF\r\n\x1a\n\x09" + bytes(100), b"\x89HDF\r\n\x1a\n" + bytes(20)):
        (tmp_path / "x.h5").write_bytes(raw)
        with pytest.raises(Unsupported):
            hdf5.Hdf5Source(spark, str(tmp_path / "x.h5"))
    example(tmp_path / "a.h5")
    whole = (tmp_path / "a.h5").read_bytes()
    for n in range(100, len(whole), len(whole) // 12):  # cut anywhere: an error, or what is left of it
        (tmp_path / "x.h5").write_bytes(whole[:n])
        with pytest.raises(Unsupported):
            hdf5.Hdf5Source(spark, str(tmp_path / "x.h5"))


def test_fill_values(tmp_path):
    write_hdf5(str(tmp_path / "x.h5"), {"a": Array(np.arange(6, dtype="f4"), chunk=(2,), fill=np.float32(-9))})
    raw = (tmp_path / "x.h5").read_bytes()
    with File(str(tmp_path / "x.h5")) as f:
        data = f.object(f.root.links["a"])
        assert data.fill == np.float32(-9).tobytes() and data.read().tolist() == [0, 1, 2, 3, 4, 5]
        keep = list(data.chunks((0,), (6,)))
        data.chunks = lambda starts, counts: iter([keep[0], keep[2]])
        assert data.read().tolist() == [0, 1, -9, -9, 4, 5]
    assert len(raw) % 8 == 0
