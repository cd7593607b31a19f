"""Registered queries over a folder of datasets, its catalog, its service and the bytes that it answers.

The folder is made of the test tables: ``events`` cut in two chunk stores that are
listed in the wrong order, descriptions that join them, and things that a scan skips.
"""

from __future__ import annotations

import json
import logging
import os
import struct
import threading
import urllib.request
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import load
from .functions.attributes import Attribute, attribute_text
from .functions.wire import SEPARATOR, wire_dtype
from .operators.catalog import Catalog, NotListed, list_folder
from .plans.schema import TYPES, BindError, ElementType
from .queries import WIDTH, _folder_sql, _line_sql, _PATHS, catalog_list, embeddings, events, lines, query, read
from .server import Service, serve
from .session import importable, shared_folder
from .sources.aggregate import DescriptionError, read_description
from .sources.base import Dataset, Together
from .sources.chunks import write_store
from .sources.hdf5_write import Array, write_hdf5
from .sources.scan import dataset_files, open_dataset, open_folder
from .sources.tables import TableSource
from .streaming.body import encoded_rows

# Fixed value: the name space of descriptions.
NCML = '<?xml version="1.0" encoding="UTF-8"?>\n<netcdf xmlns="http://www.unidata.ucar.edu/namespaces/netcdf/ncml-2.2">{}</netcdf>'
JOIN = '<aggregation dimName="event" type="joinExisting">{}</aggregation>'
_FOLDERS: dict[tuple[str, str], str] = {}


def half(spark: SparkSession, sf_dir: str, low: int, high: int, zone: int) -> Together:
    """Rows ``low`` to ``high - 1`` of ``events``, and ``zone``, which isn't along their dimension and differs between halves."""
    rows = read(spark, sf_dir, "events").where(F.col("event_id").between(low, high - 1)).select((F.col("event_id") - low).alias("n"), F.col("event_id").alias("event"), "user_id", "value")
    zones = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n"), (F.col("r_regionkey") + zone).alias("zone"))
    about = {None: [Attribute("title", "String", ("events",))], "value": [Attribute("units", "String", ("1",))]}
    return Together(TableSource(rows, "event", "n", coordinate="event", attributes=about), TableSource(zones, "zone", "n", coordinate="zone"))


def folder(spark: SparkSession, sf_dir: str) -> str:
    """The folder of datasets, made once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _FOLDERS:
        return _FOLDERS[key]
    top = shared_folder(spark, "folder")
    n = read(spark, sf_dir, "events").count()
    write_store(f"{top}/a-late.slab", half(spark, sf_dir, n // 2, n, 100), chunk_cells=256)
    write_store(f"{top}/sub/early.slab", half(spark, sf_dir, 0, n // 2, 0), chunk_cells=256)
    os.makedirs(f"{top}/.hidden")
    for name, text in {
        "joined.ncml": NCML.format(JOIN.format('<netcdf location="a-late.slab"/><netcdf/><other location="x"/><netcdf location="sub/early.slab"/>')),
        "sub/scanned.ncml": NCML.format(JOIN.format('<scan location=".." suffix=".slab" ignore="nothing"/>')),
        "sub/early-only.ncml": NCML.format(JOIN.format('<scan location=".." suffix=".slab" ignore="late"/>')),
        "broken.ncml": NCML.format("<variable/>"),
        ".hidden.ncml": "x",
        ".hidden/inside.ncml": "x",
        "notes.txt": "x",
        "UPPER.NC": "x",
    }.items():
        with open(f"{top}/{name}", "w") as f:
            f.write(text)
    _FOLDERS[key] = top
    return top


def values(columns: str, *rows: tuple) -> str:
    """SQL of constant rows."""
    def one(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


KEYS = ("a-late.slab", "broken.ncml", "joined.ncml", "sub/early-only.ncml", "sub/early.slab", "sub/scanned.ncml")


@query(values("place, key", *enumerate(KEYS)))
def folder_datasets(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(k for k, _ in sorted(dataset_files(folder(spark, sf_dir))))), "place int, key string")


@query(values("key", *((k,) for k in KEYS if k != "broken.ncml")))
def folder_opened(spark, sf_dir):
    """What doesn't open is told of and left out."""
    return spark.createDataFrame([(k,) for k in open_folder(spark, folder(spark, sf_dir)).paths()], "key string")


@query(values("description, dim, member", *(("joined", "event", m) for m in ("a-late.slab", "sub/early.slab")), *(("sub/scanned", "event", m) for m in ("a-late.slab", "sub/early.slab")), ("sub/early-only", "event", "sub/early.slab")))
def description_members(spark, sf_dir):
    top, rows = folder(spark, sf_dir), []
    for name in ("joined", "sub/scanned", "sub/early-only"):
        dim, members = read_description(f"{top}/{name}.ncml")
        rows += [(name, dim, os.path.relpath(os.path.realpath(m), os.path.realpath(top))) for m in members]
    return spark.createDataFrame(rows, "description string, dim string, member string")


BAD = {"empty": "", "other first": f"<variable/>{JOIN.format('')}", "union": '<aggregation type="union" dimName="event"/>', "no type": '<aggregation dimName="event"/>', "no dimension": '<aggregation type="joinExisting"/>', "no suffix": JOIN.format('<scan location="."/>')}


@query(f"SELECT r_name AS region, description, refused, CASE WHEN NOT refused THEN 'along ' || r_name END AS dim FROM region, ({values('description, refused', *((k, True) for k in BAD), ('supported', False))})")
def description_errors(spark, sf_dir):
    """Descriptions along a dimension that is named after each region: which are refused, and the dimension of the others."""
    top, rows = shared_folder(spark, "bad"), []
    for r in read(spark, sf_dir, "region").select("r_name").toLocalIterator():
        for kind, inner in (BAD | {"supported": JOIN.format("")}).items():
            with open(f"{top}/bad.ncml", "w") as f:
                f.write(NCML.format(inner).replace('dimName="event"', f'dimName="along {r["r_name"]}"'))
            try:
                rows.append((r["r_name"], kind, False, read_description(f"{top}/bad.ncml")[0]))
            except DescriptionError:
                rows.append((r["r_name"], kind, True, None))
    return spark.createDataFrame(rows, "region string, description string, refused boolean, dim string")


def joined_events(spark: SparkSession, sf_dir: str, name: str = "joined") -> Dataset:
    return open_dataset(spark, f"{folder(spark, sf_dir)}/{name}.ncml")


_MIDDLE = "event_id BETWEEN (SELECT count(*) // 2 FROM events) - 90 AND (SELECT count(*) // 2 FROM events) + 89"


def middle(d: Dataset) -> str:
    at = d.schema.find("event").shape[0] // 2
    return f"[{at - 90}:{at + 89}]"


@query(f"SELECT event_id::INT AS i_event, value FROM events WHERE {_MIDDLE}")
def joined_folder(spark, sf_dir):
    d = joined_events(spark, sf_dir)
    return d.cells(f"value{middle(d)}")[0][1]


@query("SELECT event_id::INT AS i_event, user_id AS value FROM events")
def joined_folder_whole(spark, sf_dir):
    return joined_events(spark, sf_dir, "sub/scanned").cells("user_id")[0][1]


@query(f"SELECT event_id::INT AS i_event, event_id AS value FROM events WHERE {_MIDDLE}")
def joined_folder_coordinate(spark, sf_dir):
    d = joined_events(spark, sf_dir)
    return d.cells(f"event{middle(d)}")[0][1]


@query("SELECT r_regionkey::INT AS i_zone, r_regionkey::INT AS value FROM region")
def joined_folder_first_member(spark, sf_dir):
    """A variable without the joined dimension comes from the member that is first by coordinate, though listed last."""
    return joined_events(spark, sf_dir).cells("zone")[0][1]


@query(values("box, member", ("first", "early.slab"), ("last", "a-late.slab"), ("middle", "a-late.slab"), ("middle", "early.slab")))
def joined_folder_members_read(spark, sf_dir):
    """Members that a box doesn't touch aren't in its plan."""
    d = joined_events(spark, sf_dir)
    n, rows = d.schema.find("event").shape[0], set()
    for box, text in (("first", "[0:3]"), ("last", f"[{n - 2}]"), ("middle", middle(d))):
        rows |= {(box, next(x for x in path.split("/") if x.endswith(".slab"))) for path in d.cells(f"value{text}")[0][1].inputFiles()}
    return spark.createDataFrame(sorted(rows), "box string, member string")


_FILTERED = 'Attributes {\n    NC_GLOBAL {\n        String title "{n} events";\n    }\n    value {\n        Float64 limit +1.5E0, -2.0E7;\n        Int16 flag 3;\n        Int32 rows {n};\n        \n        Byte b 255;\n    }\n}'


@query(_line_sql(_FILTERED).replace("FROM embeddings", "FROM events"))
def attribute_filter(spark, sf_dir):
    """Attributes of the file's own book-keeping and of types that aren't served are left out; unsigned ones keep a line."""
    n = events(spark, sf_dir).source.length
    own = [Attribute("limit", "Float64", (1.5, -2e7)), Attribute("_Netcdf4Dimid", "Int32", (n,)), Attribute("flag", "Int16", (3,)), Attribute("rows", "Int32", (n,)), Attribute("odd", "unsupported", (n,)), Attribute("u", "UInt16", (n,)), Attribute("b", "Byte", (255,)), Attribute("DIMENSION_LIST", "String", ("x",))]
    return lines(spark, attribute_text(["value"], {None: [Attribute("title", "String", (f"{n} events",)), Attribute("_NCProperties", "String", ("y",))], "value": own}))


_WHOLE_EVENTS = [f"    {t} {v}[event = {{n}}];" for t, v in (("Int64", "event"), ("Int64", "user_id"), ("Float64", "value"))]


@query(f"SELECT n, replace(line, '{{n}}', (SELECT count(*) FROM events)::VARCHAR) AS line FROM ({values('n, line', *enumerate(['Dataset {', *_WHOLE_EVENTS, '} events;']))})")
def constraint_fallback(spark, sf_dir):
    """A query that doesn't parse asks the service for everything."""
    return lines(spark, str(events(spark, sf_dir).bind("value[x", on_malformed="all")))


CONSTRAINTS = {
    "label[0:2:9]": "label: steps aren't supported",
    "label[7:3]": "label: a range runs backwards",
    "label[0][0]": "label: more brackets than dimensions",
    "embedding[0][64]": "embedding: an index is out of range",
    "embedding[0][60:64]": "embedding: a range ends past its dimension",
    "embedding[0:1][63]": "",
    "nothing": "no variable nothing",
    "embedding.nothing[1]": "no variable nothing",
}


@query(values('"constraint", problem', *CONSTRAINTS.items()))
def constraint_errors(spark, sf_dir):
    d, rows = embeddings(spark, sf_dir), []
    for text in CONSTRAINTS:
        try:
            d.bind(text)
            rows.append((text, ""))
        except BindError as e:
            rows.append((text, str(e)))
    return spark.createDataFrame(rows, "constraint string, problem string")


def ordered(found: DataFrame) -> DataFrame:
    """Folders and datasets with their places: each kind sorted by name."""
    return found.select("kind", "name", (F.row_number().over(Window.partitionBy("kind").orderBy("name")) - 1).alias("place"))


@query(f"SELECT kind, name, (row_number() OVER (PARTITION BY kind ORDER BY name) - 1)::INT AS place FROM ({_folder_sql('')})")
def catalog_order(spark, sf_dir):
    return ordered(list_folder(catalog_list(spark, sf_dir)))


_HOST = f"(SELECT min(split_part(key, '/', 1)) FROM ({_PATHS}) WHERE key LIKE '%/%/%')"


@query(
    f"""SELECT kind, name, (row_number() OVER (PARTITION BY kind ORDER BY name) - 1)::INT AS place FROM (
  SELECT DISTINCT CASE WHEN instr(rest, '/') > 1 THEN 'folder' ELSE 'dataset' END AS kind, CASE WHEN instr(rest, '/') > 1 THEN split_part(rest, '/', 1) ELSE rest END AS name
  FROM (SELECT substr(key, length({_HOST}) + 2) AS rest FROM ({_PATHS}) WHERE starts_with(key, {_HOST} || '/')))"""
)
def catalog_folder_prefix(spark, sf_dir):
    keys = catalog_list(spark, sf_dir)
    (host,) = keys.where(F.col("key").like("%/%/%")).agg(F.min(F.substring_index("key", "/", 1))).first()
    return ordered(list_folder(keys, host))


@query(
    values(
        "path, dataset, folder",
        ("joined.ncml", True, False), ("sub", False, True), ("sub/", False, True), ("sub/early.slab", True, False), ("sub/none", False, False), ("SUB", False, False), ("", False, True), ("early.slab", False, False),
    )
)
def catalog_lookup(spark, sf_dir):
    """A key is a dataset, a prefix of keys a folder, and a dataset is no folder."""
    catalog = Catalog([k for k, _ in dataset_files(folder(spark, sf_dir))])

    def found(look, path: str) -> bool:
        try:
            look(path)
            return True
        except NotListed:
            return False

    return spark.createDataFrame([(p, found(catalog.get, p), found(catalog.folder, p)) for p in ("joined.ncml", "sub", "sub/", "sub/early.slab", "sub/none", "SUB", "", "early.slab")], "path string, dataset boolean, folder boolean")


_TEXT_LENGTH = "length('Dataset {' || chr(10) || '    Float64 value[event = ' || {n} || '];' || chr(10) || '} events;')"


@query(f"SELECT 'value[0:9]' AS \"constraint\", {_TEXT_LENGTH.replace('{n}', '10')} + 8 + 8 + 80 AS length UNION ALL SELECT 'value', {_TEXT_LENGTH.replace('{n}', 'count(*)')} + 8 + 8 + 8 * count(*) FROM events")
def content_length(spark, sf_dir):
    d = events(spark, sf_dir)
    return spark.createDataFrame([(q, d.bind(q).content_length) for q in ("value[0:9]", "value")], "constraint string, length long")


def decoded(body: bytes) -> tuple[str, np.ndarray]:
    """Schema text and the doubles of a response with one variable of type Float64; lengths are checked."""
    head, _, rest = body.partition(SEPARATOR)
    n, again = struct.unpack(">II", rest[:8])
    found = np.frombuffer(rest, ">f8", offset=8)
    if n != again or n != len(found):
        raise ValueError("the lengths don't agree")
    return head.decode(), found


@query("SELECT (event_id - 100)::INT AS place, value FROM events WHERE event_id BETWEEN 100 AND 299")
def dods_cells(spark, sf_dir):
    """A whole data response, taken apart again by its framing."""
    _, found = decoded(b"".join(events(spark, sf_dir).dods("value[100:299]")[1]))
    return spark.createDataFrame(list(enumerate(found.tolist())), "place int, value double")


@query(values("n, line", *enumerate("Dataset {\n    Float64 value[event = 200];\n} events;".split("\n"))))
def dods_header(spark, sf_dir):
    return lines(spark, decoded(b"".join(events(spark, sf_dir).dods("value[100:299]")[1]))[0])


def undone(encoded: DataFrame, kind: ElementType) -> DataFrame:
    """``place, value`` of encoded batches, by numpy's reading of the wire type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(payload, wire_dtype(kind)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(found))), pa.array(found)], ["place", "value"])

    return encoded.select("first", "payload").mapInArrow(run, "place long, value double")


_SMALL = {"Byte": "label + 240", "Int16": "label * 700 - 3000", "UInt16": "label * 7000", "Int32": "label - 4", "UInt32": "label::BIGINT * 400000000"}


@query(
    " UNION ALL ".join([f"SELECT '{k}' AS type, vec_id AS place, ({e})::DOUBLE AS value FROM embeddings" for k, e in _SMALL.items()])
    + f" UNION ALL SELECT 'Float32', vec_id * {WIDTH} + d, embedding[d + 1]::DOUBLE FROM embeddings, range({WIDTH}) t(d) UNION ALL SELECT 'Float64', event_id, value FROM events"
)
def xdr_values(spark, sf_dir):
    """Elements of each type through the wire form that tasks encode, and back."""
    importable(spark)
    table, parts = read(spark, sf_dir, "embeddings"), []
    for name, e in _SMALL.items():
        cells = table.select(F.col("vec_id").alias("i"), F.expr(e.replace("::BIGINT", "")).cast("bigint").alias("value")) if "::" not in e else table.select(F.col("vec_id").alias("i"), (F.col("label").cast("bigint") * 400000000).alias("value"))
        parts.append(undone(encoded_rows(cells, ["i"], TYPES[name], F.col("i")), TYPES[name]).withColumn("type", F.lit(name)))
    d, e = embeddings(spark, sf_dir), events(spark, sf_dir)
    parts.append(undone(encoded_rows(d.cells("embedding")[0][1], ["i_vec", "i_dim"], TYPES["Float32"], F.col("i_vec").cast("long") * WIDTH + F.col("i_dim")), TYPES["Float32"]).withColumn("type", F.lit("Float32")))
    parts.append(undone(encoded_rows(e.cells("value")[0][1], ["i_event"], TYPES["Float64"], F.col("i_event")), TYPES["Float64"]).withColumn("type", F.lit("Float64")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("type", "place", "value")


@query("SELECT vec_id AS place, printf('%08x', (label - 4)::BIGINT & 4294967295) AS word FROM embeddings")
def xdr_widened(spark, sf_dir):
    """16-bit elements take 32 bits on the wire, with their sign."""
    importable(spark)
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), (F.col("label") - 4).cast("smallint").alias("value"))
    word = encoded_rows(cells, ["i"], TYPES["Int16"], F.col("i")).select("first", "payload", F.explode(F.sequence(F.lit(0), (F.octet_length("payload") / 4).cast("int") - 1)).alias("k"))
    return word.select((F.col("first") + F.col("k")).alias("place"), F.lower(F.hex(F.substring("payload", F.col("k") * 4 + 1, F.lit(4)))).alias("word"))


def service(spark: SparkSession, sf_dir: str) -> Service:
    top = folder(spark, sf_dir)
    found = {k: open_dataset(spark, f"{top}/{k}", k) for k in ("joined.ncml", "sub/early.slab")}
    return Service(Catalog(found), "/root")


@query(values("key", ("joined.ncml",), ("sub/early.slab",)))
def catalog_json(spark, sf_dir):
    body = b"".join(service(spark, sf_dir).reply("/data", accept="application/json").body)
    return spark.createDataFrame([(k,) for k in json.loads(body)], "key string")


ROUTES = [
    ("/", "", 200, "text/html"), ("/data", "", 200, "text/html"), ("/data", "application/json", 200, "application/json"), ("/data/", "", 200, "text/html"), ("/data/sub", "", 200, "text/html"), ("/data/sub/", "", 200, "text/html"),
    ("/data/joined.ncml.das", "", 200, "text/plain; charset=utf-8"), ("/data/joined.ncml.das?value[", "", 200, "text/plain; charset=utf-8"), ("/data/joined.ncml.dds", "", 200, "text/plain; charset=utf-8"), ("/data/joined.ncml.dds?value[0:2:4]", "", 400, "text/plain; charset=utf-8"),
    ("/data/joined.ncml.dods?value[0:3]", "", 200, "application/octet-stream"), ("/data/joined.ncml.dods?value[0:2:4]", "", 400, "text/plain; charset=utf-8"), ("/data/joined.ncml", "", 404, "text/plain; charset=utf-8"), ("/data/none.dds", "", 404, "text/plain; charset=utf-8"), ("/data/none/", "", 404, "text/plain; charset=utf-8"), ("/other", "", 404, "text/plain; charset=utf-8"),
]


@query(values("route, accept, status, kind", *ROUTES))
def http_routes(spark, sf_dir):
    s, rows = service(spark, sf_dir), []
    for route, accept, *_ in ROUTES:
        path, mark, text = route.partition("?")
        reply = s.reply(path, text if mark else None, accept)
        rows.append((route, accept, reply.status, reply.headers["Content-Type"]))
    return spark.createDataFrame(rows, "route string, accept string, status int, kind string")


@query(values("folder, link", ("", "/root/data/sub"), ("", "/root/data/joined.ncml"), *(("", f"/root/data/joined.ncml{s}") for s in (".das", ".dds")), ("sub", "/root/data/sub/early.slab"), *(("sub", f"/root/data/sub/early.slab{s}") for s in (".das", ".dds"))))
def http_links(spark, sf_dir):
    """Links of the folder pages, once each."""
    s, rows = service(spark, sf_dir), set()
    for name in ("", "sub"):
        text = b"".join(s.reply(f"/data/{name}").body).decode()
        rows |= {(name, part.partition('"')[0]) for part in text.split('href="')[1:]}
    return spark.createDataFrame(sorted(rows), "folder string, link string")


@contextmanager
def running(spark: SparkSession, catalog: Catalog) -> Iterator[str]:
    server = serve(spark, catalog, "127.0.0.1", 0)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        yield f"http://127.0.0.1:{server.server_port}"
    finally:
        server.shutdown()
        server.server_close()
        thread.join()


@query(f"SELECT 'joined.ncml' AS key, (event_id - (SELECT count(*) // 2 FROM events) + 90)::INT AS place, value FROM events WHERE {_MIDDLE}")
def http_data(spark, sf_dir):
    """A data response over a socket."""
    d = joined_events(spark, sf_dir)
    with running(spark, Catalog({"joined.ncml": d})) as url, urllib.request.urlopen(f"{url}/data/joined.ncml.dods?value{middle(d)}") as r:
        body = r.read()
        if int(r.headers["Content-Length"]) != len(body) or r.headers["Content-Description"] != "dods-data":
            raise ValueError("the headers don't fit the body")
    return spark.createDataFrame([("joined.ncml", k, v) for k, v in enumerate(decoded(body)[1].tolist())], "key string, place int, value double")


@query(values("method, path, status", ("GET", "/data", 200), ("GET", "/data/joined.ncml.das", 200)))
def request_log(spark, sf_dir):
    """The log has a line with method, path, status and time for each request."""
    log, seen = logging.getLogger("slabworks.server"), []

    class Keep(logging.Handler):
        def emit(self, record):
            seen.append(record.args[:3])

    keep, level = Keep(), log.level
    log.addHandler(keep)
    log.setLevel(logging.DEBUG)
    try:
        with running(spark, Catalog({"joined.ncml": joined_events(spark, sf_dir)})) as url:
            for path in ("/data", "/data/joined.ncml.das"):
                urllib.request.urlopen(f"{url}{path}").read()
    finally:
        log.removeHandler(keep)
        log.setLevel(level)
    return spark.createDataFrame(seen, "method string, path string, status int")


_CONFIGS = """SELECT n_name AS name, s.source, CASE s.source WHEN 'none' THEN 'data/' WHEN 'file' THEN n_name || '/' ELSE 'one' END AS data, CASE s.source WHEN 'none' THEN '127.0.0.1' WHEN 'file' THEN '0.0.0.0' ELSE '::1' END AS host,
  (CASE s.source WHEN 'none' THEN 8001 WHEN 'file' THEN 8100 + n_nationkey ELSE 9000 + n_nationkey END)::INT AS port, CASE s.source WHEN 'none' THEN '' WHEN 'file' THEN '/x' ELSE '/y' END AS root_url, CASE s.source WHEN 'none' THEN './slabworks.index' ELSE n_name END AS index
  FROM nation, (VALUES ('none'), ('file'), ('options')) s(source)"""


@query(_CONFIGS)
def service_config(spark, sf_dir):
    """Settings of a service for each nation: without a file, by its file, and by options above its file."""
    top, rows = shared_folder(spark, "config"), []
    for n in read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).toLocalIterator():
        for kind, body in (("none", ""), ("some", f'data = "{n["name"]}/"\naddress = "0.0.0.0:{8100 + n["key"]}"\nroot_url = "/x"\n[db]\npath = "{n["name"]}"\n')):
            with open(f"{top}/{kind}.toml", "w") as f:
                f.write(body)
        found = [("none", load(["-c", f"{top}/none.toml"])), ("file", load(["-c", f"{top}/some.toml"])), ("options", load(["-c", f"{top}/some.toml", "-a", f"[::1]:{9000 + n['key']}", "--root-url", "/y", "one", "two"]))]
        rows += [(n["name"], source, c.data, *c.host_port, c.root_url, c.index) for source, c in found]
    return spark.createDataFrame(rows, "name string, source string, data string, host string, port int, root_url string, index string")


def grid_file(spark: SparkSession, sf_dir: str) -> str:
    """``embeddings`` as a file of two dimensions with their scales: chunks of 16-bit integers and of floats, shuffled and deflated."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} grid")
    if key not in _FOLDERS:
        table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").orderBy("vec_id").toArrow()
        n = table.num_rows
        vectors = np.array(table.column("embedding").combine_chunks().flatten(), np.float32).reshape(n, WIDTH)
        arrays = {
            "vec": Array(np.arange(n)),
            "dim": Array(np.arange(WIDTH, dtype=np.int32)),
            "embedding": Array(vectors, ("vec", "dim"), {"units": "1", "_FillValue": np.float32(-1e34)}, (50, 16)),
            "label": Array(np.array(table.column("label"), ">i2"), ("vec",), {}, (64,)),
            "half": Array(vectors[: n // 2].astype("<f8"), (), {}),
            "names": Array(np.array([b"a", b"b"])),
            "nothing": Array(np.zeros(0)),
        }
        _FOLDERS[key] = shared_folder(spark, "grid")
        write_hdf5(f"{_FOLDERS[key]}/grid.nc4", arrays, {"title": "vectors", "_NCProperties": "x"})
    return f"{_FOLDERS[key]}/grid.nc4"


def grid(spark: SparkSession, sf_dir: str) -> Dataset:
    return open_dataset(spark, grid_file(spark, sf_dir), "grid")


@query(
    _line_sql(
        "Dataset {\n    Int32 dim[dim = 64];\n    Grid {\n     ARRAY:\n        Float32 embedding[vec = {n}][dim = 64];\n     MAPS:\n        Int64 vec[vec = {n}];\n        Int32 dim[dim = 64];\n    } embedding;\n"
        "    Float64 half[half = {h}];\n    Int16 label[vec = {n}];\n    Int64 vec[vec = {n}];\n} grid;"
    ).replace("replace('", "replace(replace('").replace("(SELECT count(*) FROM embeddings)::VARCHAR)", "(SELECT count(*) FROM embeddings)::VARCHAR), '{h}', (SELECT count(*) // 2 FROM embeddings)::VARCHAR)")
)
def hdf5_schema(spark, sf_dir):
    """Dimensions come from the scales' references; text and arrays without storage aren't served."""
    return lines(spark, grid(spark, sf_dir).dds())


@query(
    _line_sql(
        'Attributes {\n    NC_GLOBAL {\n        String title "vectors";\n    }\n    dim {\n    }\n    embedding {\n        String units "1";\n        Float32 _FillValue -1.0E34;\n    }\n    half {\n    }\n    label {\n    }\n    names {\n    }\n    vec {\n    }\n}'
    )
)
def hdf5_attributes(spark, sf_dir):
    return lines(spark, grid(spark, sf_dir).das())


_VECTORS = f"SELECT vec_id::INT AS i_vec, d::INT AS i_dim, embedding[d + 1] AS value FROM embeddings, range({WIDTH}) t(d)"


@query(_VECTORS)
def hdf5_whole(spark, sf_dir):
    return grid(spark, sf_dir).cells("embedding")[0][1]


@query(f"{_VECTORS} WHERE vec_id BETWEEN 30 AND 120 AND d BETWEEN 10 AND 40")
def hdf5_slab(spark, sf_dir):
    """A box over several chunks both ways."""
    return grid(spark, sf_dir).cells("embedding[30:120][10:40]")[0][1]


@query("SELECT vec_id::INT AS i_vec, label::SMALLINT AS value FROM embeddings")
def hdf5_integers(spark, sf_dir):
    return grid(spark, sf_dir).cells("label")[0][1]


@query("SELECT vec_id AS place, printf('%08x', label) AS word FROM embeddings")
def hdf5_payload(spark, sf_dir):
    """16-bit integers of a file, as a data response has them."""
    body = b"".join(grid(spark, sf_dir).dods("label")[1]).partition(SEPARATOR)[2][8:]
    return spark.createDataFrame([(k, body[4 * k : 4 * k + 4].hex()) for k in range(len(body) // 4)], "place long, word string")


@query(values("route, status, disposition, same", ("/data/grid.nc4", 200, "attachment", True), ("/data/none.nc4", 404, "", False)))
def http_raw(spark, sf_dir):
    """The file itself, and what there isn't."""
    path = grid_file(spark, sf_dir)
    s, rows = Service(Catalog({"grid.nc4": open_dataset(spark, path)})), []
    with open(path, "rb") as f:
        raw = f.read()
    for route in ("/data/grid.nc4", "/data/none.nc4"):
        reply = s.reply(route)
        rows.append((route, reply.status, reply.headers.get("Content-Disposition", ""), b"".join(reply.body) == raw))
    return spark.createDataFrame(rows, "route string, status int, disposition string, same boolean")


@query("SELECT vec_id::INT AS i_vec, label::SMALLINT AS value FROM embeddings WHERE vec_id BETWEEN (SELECT count(*) // 2 FROM embeddings) - 20 AND (SELECT count(*) // 2 FROM embeddings) + 19")
def hdf5_joined(spark, sf_dir):
    """A range over two files that a description joins, listed in the wrong order."""
    top = shared_folder(spark, "members")
    labels = [r["label"] for r in read(spark, sf_dir, "embeddings").select("vec_id", "label").orderBy("vec_id").collect()]
    h = len(labels) // 2
    for name, first, own in (("a", h, labels[h:]), ("b", 0, labels[:h])):
        write_hdf5(f"{top}/{name}.nc", {"vec": Array(np.arange(first, first + len(own))), "label": Array(np.array(own, np.int16), ("vec",), {}, (32,))})
    with open(f"{top}/all.ncml", "w") as f:
        f.write(NCML.format('<aggregation dimName="vec" type="joinExisting"><scan location="." suffix=".nc"/></aggregation>'))
    return open_dataset(spark, f"{top}/all.ncml").cells(f"label[{h - 20}:{h + 19}]")[0][1]
