import pytest

from slabworks.functions.attributes import Attribute, attribute_text, quoted, real
from slabworks.functions.wire import length_header, widen
from slabworks.plans.query import parse_query
from slabworks.plans.schema import TYPES, BindError, Schema, Variable

T = TYPES
CUBE = (("depth", "lat", "lon"), (10, 30, 70))
SEA = Schema(
    "sea",
    [
        Variable("lat", T["Float64"], ("lat",), (30,)),
        Variable("lon", T["Float64"], ("lon",), (70,)),
        Variable("depth", T["Float64"], ("depth",), (10,)),
        *(Variable(n, T["Float32"], *CUBE) for n in ("salt", "heat")),
    ],
)


def ask(text, schema=SEA):
    return schema.bind(parse_query(text))


# The layout of schema text is the protocol's.
def grid(name):
    return f"""    Grid {{
     ARRAY:
        Float32 {name}[depth = 10][lat = 30][lon = 70];
     MAPS:
        Float64 depth[depth = 10];
        Float64 lat[lat = 30];
        Float64 lon[lon = 70];
    }} {name};
"""


def test_all_variables_by_name():
    depth, lat, lon = "    Float64 depth[depth = 10];\n", "    Float64 lat[lat = 30];\n", "    Float64 lon[lon = 70];\n"
    assert str(SEA.bind(())) == "Dataset {\n" + depth + grid("heat") + lat + lon + grid("salt") + "} sea;"


def test_texts_of_each_form():
    assert str(ask("depth")) == "Dataset {\n    Float64 depth[depth = 10];\n} sea;"
    assert str(ask("depth[1:7]")) == "Dataset {\n    Float64 depth[depth = 7];\n} sea;"
    assert str(ask("salt")) == "Dataset {\n" + grid("salt") + "} sea;"
    assert str(ask("salt.salt")) == "Dataset {\n    Structure {\n        Float32 salt[depth = 10][lat = 30][lon = 70];\n    } salt;\n} sea;"
    assert str(ask("salt.depth[1:7]")) == "Dataset {\n    Structure {\n        Float64 depth[depth = 7];\n    } salt;\n} sea;"


def test_sizes():
    whole, slab, depth = ask("salt.salt"), ask("salt.salt[2:4][5:9][60:69]"), ask("salt.depth[1:7]")
    assert (whole.stored_bytes, whole.wire_bytes) == (84_000, 84_008)
    assert (slab.stored_bytes, slab.wire_bytes) == (600, 608)
    assert "[depth = 3][lat = 5][lon = 10]" in str(slab)
    assert depth.stored_bytes == 56
    assert whole.content_length == len(str(whole)) + 8 + 84_008
    g = ask("salt[1][2:3]")
    assert [leaf.counts for leaf in g.leaves] == [(1, 2, 70), (1,), (2,), (70,)]
    assert [leaf.starts for leaf in g.leaves] == [(1, 2, 0), (1,), (2,), (0,)]


def test_order_is_that_of_the_source():
    assert [p.outer for p in ask("heat,depth,salt,lon,lat").parts] == ["lat", "lon", "depth", "salt", "heat"]
    assert [(p.outer, p.kind) for p in ask("salt.depth,depth,salt,salt.salt").parts] == [("depth", "variable"), ("salt", "structure"), ("salt", "grid"), ("salt", "structure")]


@pytest.mark.parametrize("text", ["salt[0:3:9][0:4],depth", "nothing", "salt.nothing", "nothing.salt", "depth[10]", "depth[0:10]", "depth[8:2]", "depth[0][0]", "", "SALT", "salt[0][0:30]"])
def test_queries_that_do_not_fit(text):
    with pytest.raises(BindError):
        ask(text)


def test_grids_need_every_coordinate():
    one = Schema("1d", [Variable("data", T["Float32"], ("x1",), (2,)), Variable("x1", T["Int64"], ("x1",), (2,))])
    assert str(one.bind(())) == "Dataset {\n    Float32 data[x1 = 2];\n    Int64 x1[x1 = 2];\n} 1d;"
    data = Variable("data", T["Float32"], ("x1", "y1"), (2, 3))
    x, y = Variable("x1", T["Int64"], ("x1",), (2,)), Variable("y1", T["Int64"], ("y1",), (3,))
    assert Schema("2d", [data, x, y]).bind(()).parts[0].kind == "grid"
    assert Schema("2d", [data, x]).bind(()).parts[0].kind == "variable"
    assert Schema("2d", [data, x, Variable("y1", None, ("y1",), (3,))]).bind(()).parts[0].kind == "variable"


def test_odd_shapes():
    s = Schema("odd", [Variable("one", T["Int32"], (), ()), Variable("flat", T["Int16"], ("flat",), (3, 4)), Variable("none", T["Byte"], ("t", "x"), (0, 4))])
    one, flat = s.bind(parse_query("one")), s.bind(parse_query("flat"))
    assert str(one) == "Dataset {\n    Int32 one;\n} odd;" and one.wire_bytes == 4
    assert str(flat) == "Dataset {\n    Int16 flat[flat = 3];\n} odd;" and flat.wire_bytes == 12 * 4 + 8 and flat.stored_bytes == 24
    assert s.bind(parse_query("none")).wire_bytes == 8
    with pytest.raises(BindError):
        s.bind(parse_query("none[0]"))


def test_attribute_text():
    common = [Attribute("_FillValue", "Float32", (-1e34,)), Attribute("history", "String", ("made by hand",)), Attribute("DIMENSION_LIST", "String", ("x",)), Attribute("flag", "unsupported", (1,))]
    text = attribute_text(["depth", "salt"], {None: [Attribute("history", "String", ("a",))], "salt": [*common, Attribute("n", "Int16", (1, 2)), Attribute("u", "UInt16", (1,)), Attribute("b", "Byte", (200,))]})
    assert text == (
        'Attributes {\n    NC_GLOBAL {\n        String history "a";\n    }\n    depth {\n    }\n    salt {\n        Float32 _FillValue -1.0E34;\n'
        '        String history "made by hand";\n        Int16 n 1, 2;\n        \n        Byte b 200;\n    }\n}'
    )
    assert attribute_text([], {}) == "Attributes {\n}"
    assert [real(x) for x in (0.0, 1.0, -2.5e-7, float("nan"), float("inf"))] == ["+0.0E0", "+1.0E0", "-2.5E-7", "NaN", "+inf"]
    assert quoted("a\"b'\n\té\\") == '"a\\"b\\\'\\n\\t\\u{e9}\\\\"'


def test_wire_helpers():
    assert length_header(2).hex() == "0000000200000002"
    assert widen(b"\x00\x02\xff\xfe", T["Int16"]).hex() == "00000002fffffffe"
    assert widen(b"\x02\x00", T["UInt16"], "little").hex() == "00000002"
    assert widen(b"\x00\xff", T["Byte"]).hex() == "00ff"
    with pytest.raises(ValueError):
        widen(b"\0\0\0\0", T["Int32"])
