"""Registered queries over the test tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.attributes import Attribute
from .functions.index import dense_index
from .functions.wire import length_header
from .operators.catalog import list_folder
from .operators.join_existing import first_member, joined, joined_range, member_offsets, member_stats, pieces
from .plans.schema import Schema, Variable
from .sources.aggregate import JoinedSource
from .sources.base import Dataset
from .sources.tables import TableSource
from .streaming.body import encoded_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WIDTH = 64


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Dataset:
    """1-d variables ``user_id`` and ``value`` along ``event``; strings and times aren't served."""
    return Dataset("events", TableSource(read(spark, sf_dir, "events"), "event", "event_id"))


def embeddings(spark: SparkSession, sf_dir: str) -> Dataset:
    """``embedding`` over ``vec`` and ``dim``, both with coordinates, so a grid."""
    about = {"embedding": [Attribute("units", "String", ("1",)), Attribute("_FillValue", "Float32", (-1e34,))]}
    return Dataset("embeddings", TableSource(read(spark, sf_dir, "embeddings"), "vec", "vec_id", {"embedding": ("dim", WIDTH)}, attributes=about))


def only(dataset: Dataset, text: str) -> DataFrame:
    ((_, cells),) = dataset.cells(text)
    return cells


@query("SELECT event_id::INT AS i_event, value FROM events")
def project_variable(spark, sf_dir):
    return only(events(spark, sf_dir), "value")


@query("SELECT 0 AS position, 'user_id' AS variable, event_id::INT AS i_event, user_id::DOUBLE AS value FROM events UNION ALL SELECT 1, 'value', event_id::INT, value FROM events")
def project_multi_source_order(spark, sf_dir):
    found = events(spark, sf_dir).cells("value,user_id")
    rows = [df.select(F.lit(k).alias("position"), F.lit(part.outer).alias("variable"), "i_event", F.col("value").cast("double").alias("value")) for k, (part, df) in enumerate(found)]
    return rows[0].unionByName(rows[1])


@query("SELECT event_id::INT AS i_event, value FROM events WHERE event_id = 7")
def slab_index_1d(spark, sf_dir):
    return only(events(spark, sf_dir), "value[7]")


@query("SELECT event_id::INT AS i_event, value FROM events WHERE event_id BETWEEN 100 AND 199")
def slab_range_1d(spark, sf_dir):
    return only(events(spark, sf_dir), "value[100:199]")


_CELLS = "SELECT vec_id::INT AS i_vec, d::INT AS i_dim, embedding[d + 1] AS value FROM embeddings, range(64) t(d)"


@query(f"{_CELLS} WHERE vec_id BETWEEN 10 AND 19 AND d BETWEEN 3 AND 7")
def slab_2d(spark, sf_dir):
    return only(embeddings(spark, sf_dir), "embedding[10:19][3:7]")


@query(f"{_CELLS} WHERE vec_id = 5")
def slab_trailing_fill(spark, sf_dir):
    return only(embeddings(spark, sf_dir), "embedding[5]")


@query(_CELLS)
def whole_grid_array(spark, sf_dir):
    return only(embeddings(spark, sf_dir), "embedding")


@query(f"SELECT i_vec, i_dim, value, i_vec::BIGINT AS vec, i_dim AS dim FROM ({_CELLS}) WHERE i_vec <= 9 AND i_dim <= 3")
def grid_with_maps(spark, sf_dir):
    return embeddings(spark, sf_dir).grid("embedding[0:9][0:3]")


@query(f"SELECT i_vec, i_dim, value, i_vec::BIGINT AS vec, i_dim AS dim FROM ({_CELLS})")
def whole_grid_with_maps(spark, sf_dir):
    return embeddings(spark, sf_dir).grid("embedding")


@query("SELECT d::INT AS i_dim, d::INT AS value FROM range(2, 6) t(d)")
def structure_member(spark, sf_dir):
    return only(embeddings(spark, sf_dir), "embedding.dim[2:5]")


@query("SELECT 0 AS position, 'user_id' AS variable, 'Int64' AS type UNION ALL SELECT 1, 'value', 'Float64' UNION ALL SELECT -1, 'event', 'Int64'")
def drop_unsupported(spark, sf_dir):
    kept = events(spark, sf_dir).schema.variables
    return spark.createDataFrame([(k - 1, v.name, v.type.name) for k, v in enumerate(kept)], "position int, variable string, type string")


def year() -> Column:
    return F.year("o_orderdate")


def day() -> Column:
    return F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))


_DAY = "date_diff('day', DATE '1970-01-01', o_orderdate::DATE)"
_MEMBERS = f"""SELECT member, n, rank, coalesce(sum(n) OVER (ORDER BY rank, member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS member_start,
  (row_number() OVER (ORDER BY rank, member) - 1)::INT AS ordinal
  FROM (SELECT year(o_orderdate)::INT AS member, count(*) AS n, arg_min({_DAY}, o_orderkey)::DOUBLE AS rank FROM orders GROUP BY 1)"""
_JOINED = f"""SELECT (row_number() OVER (ORDER BY m.ordinal, o.o_orderkey) - 1)::BIGINT AS i_time, m.member, o.o_orderkey, o.o_totalprice AS value, {_DAY}::INT AS coordinate, m.ordinal
  FROM orders o JOIN ({_MEMBERS}) m ON year(o.o_orderdate) = m.member"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")


def joined_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joined(orders(spark, sf_dir), year(), day(), "o_orderkey", "i_time")
    return rows.select("i_time", "member", "o_orderkey", F.col("o_totalprice").alias("value"), day().alias("coordinate"), "ordinal")


@query(_MEMBERS)
def join_existing_members(spark, sf_dir):
    return member_offsets(member_stats(orders(spark, sf_dir), year(), day(), "o_orderkey"))


@query(f"SELECT i_time, member, value FROM ({_JOINED})")
def join_existing_full(spark, sf_dir):
    return joined_orders(spark, sf_dir).select("i_time", "member", "value")


def orders_range(spark: SparkSession, sf_dir: str, start: int, count: int) -> DataFrame:
    return joined_range(orders(spark, sf_dir), year(), day(), "o_orderkey", start, count, "i_time")


@query(f"SELECT i_time, member, value FROM ({_JOINED}) WHERE i_time BETWEEN 2200 AND 4600")
def join_existing_cross_member(spark, sf_dir):
    return orders_range(spark, sf_dir, 2200, 2401).select("i_time", "member", F.col("o_totalprice").alias("value"))


@query(f"SELECT i_time, coordinate AS value FROM ({_JOINED}) WHERE i_time BETWEEN 100 AND 2500")
def join_existing_coordinate(spark, sf_dir):
    return orders_range(spark, sf_dir, 100, 2401).select("i_time", day().alias("value"))


@query(f"SELECT i_time, o_orderkey, value FROM ({_JOINED}) WHERE ordinal = 0")
def nonaggregated_first_member(spark, sf_dir):
    rows = first_member(orders(spark, sf_dir), year(), day(), "o_orderkey")
    return dense_index(rows, ["o_orderkey"], "i_time").select("i_time", "o_orderkey", F.col("o_totalprice").alias("value"))


@query(
    f"""SELECT ordinal, greatest(2200, member_start) - member_start AS start, least(4601, member_start + n) - greatest(2200, member_start) AS count, member_start AS "offset"
  FROM ({_MEMBERS}) WHERE member_start < 4601 AND member_start + n > 2200"""
)
def member_pieces(spark, sf_dir):
    """Which members a range touches; members after its end aren't looked at."""
    sizes = [r["n"] for r in member_offsets(member_stats(orders(spark, sf_dir), year(), day(), "o_orderkey")).orderBy("ordinal").collect()]
    return spark.createDataFrame([(p.ordinal, p.start, p.count, p.offset) for p in pieces(sizes, 2200, 2401)], "ordinal int, start long, count long, offset long")


def two_tables(spark: SparkSession, sf_dir: str) -> Dataset:
    """``customer`` and then ``supplier`` as members of one dataset: ranks tell them apart, listing order doesn't."""

    def member(name: str, key: str, balance: str, first: int) -> TableSource:
        t = read(spark, sf_dir, name).select(F.col(key).alias("n"), (F.col(key) + first).alias("key"), F.col(balance).alias("balance"))
        return TableSource(t, "key", "n", coordinate="key")

    return Dataset("accounts", JoinedSource([member("supplier", "s_suppkey", "s_acctbal", 1_000_000), member("customer", "c_custkey", "c_acctbal", 0)], "key"))


@query("SELECT (c_custkey)::INT AS i_key, c_acctbal AS value FROM customer UNION ALL SELECT (s_suppkey + (SELECT count(*) FROM customer))::INT, s_acctbal FROM supplier")
def join_existing_datasets(spark, sf_dir):
    return only(two_tables(spark, sf_dir), "balance")


@query(
    """SELECT v.position, v.name, v.type, v.text, v.cells, v.cells * v.stored AS stored_bytes, v.cells * v.wire + 8 AS wire_bytes FROM (
  SELECT 0 AS position, 'vec' AS name, 'Int64' AS type, 'Int64 vec[vec = ' || n || '];' AS text, n AS cells, 8 AS stored, 8 AS wire FROM (SELECT count(*) AS n FROM embeddings)
  UNION ALL SELECT 1, 'dim', 'Int32', 'Int32 dim[dim = 64];', 64, 4, 4
  UNION ALL SELECT 2, 'embedding', 'Float32', 'Float32 embedding[vec = ' || n || '][dim = 64];', n * 64, 4, 4 FROM (SELECT count(*) AS n FROM embeddings)
  UNION ALL SELECT 3, 'label', 'Int32', 'Int32 label[vec = ' || n || '];', n, 4, 4 FROM (SELECT count(*) AS n FROM embeddings)) v"""
)
def describe_sizes(spark, sf_dir):
    d = embeddings(spark, sf_dir)
    leaves = {leaf.name: leaf for leaf in d.bind().leaves}
    rows = [(k, v.name, v.type.name, str(leaves[v.name]), leaves[v.name].cells, leaves[v.name].stored_bytes, leaves[v.name].wire_bytes) for k, v in enumerate(d.schema.variables)]
    return spark.createDataFrame(rows, "position int, name string, type string, text string, cells long, stored_bytes long, wire_bytes long")


def lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


def _line_sql(text: str) -> str:
    """SQL of the lines of a text in which ``{n}`` stands for the rows of ``embeddings``."""
    rows = " UNION ALL ".join(f"SELECT {k} AS n, replace('{x}', '{{n}}', (SELECT count(*) FROM embeddings)::VARCHAR) AS line" for k, x in enumerate(text.split("\n")))
    return rows


@query(
    _line_sql(
        "Dataset {\n    Int32 dim[dim = 64];\n    Grid {\n     ARRAY:\n        Float32 embedding[vec = {n}][dim = 64];\n     MAPS:\n        Int64 vec[vec = {n}];\n"
        "        Int32 dim[dim = 64];\n    } embedding;\n    Int32 label[vec = {n}];\n    Int64 vec[vec = {n}];\n} embeddings;"
    )
)
def describe_dds(spark, sf_dir):
    return lines(spark, embeddings(spark, sf_dir).dds())


@query(_line_sql("Dataset {\n    Structure {\n        Float32 embedding[vec = 6][dim = 11];\n    } embedding;\n    Int32 label[vec = 3];\n} embeddings;"))
def describe_dds_constrained(spark, sf_dir):
    return lines(spark, embeddings(spark, sf_dir).dds("label[0:2],embedding.embedding[0:5][10:20]"))


@query(
    _line_sql(
        'Attributes {\n    NC_GLOBAL {\n    }\n    vec {\n    }\n    dim {\n    }\n    embedding {\n        String units "1";\n        Float32 _FillValue -1.0E34;\n    }\n    label {\n    }\n}'
    )
)
def describe_das(spark, sf_dir):
    return lines(spark, embeddings(spark, sf_dir).das())


_PATHS = "SELECT regexp_replace(url, '^https?://', '') AS key FROM pages"


@query(_PATHS)
def catalog_list(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("key"))


def _folder_sql(prefix: str) -> str:
    return f"""SELECT DISTINCT CASE WHEN instr(rest, '/') > 1 THEN 'folder' ELSE 'dataset' END AS kind, CASE WHEN instr(rest, '/') > 1 THEN split_part(rest, '/', 1) ELSE rest END AS name
      FROM (SELECT substr(key, {len(prefix) + 1}) AS rest FROM ({_PATHS}) WHERE starts_with(key, '{prefix}'))"""


@query(_folder_sql(""))
def catalog_folder(spark, sf_dir):
    return list_folder(catalog_list(spark, sf_dir))


@query("SELECT 'events' AS dataset, 'value' AS variable, printf('%08x%08x', count(*), count(*)) AS header FROM events UNION ALL SELECT 'embeddings', 'embedding', printf('%08x%08x', count(*) * 64, count(*) * 64) FROM embeddings")
def xdr_length_header(spark, sf_dir):
    rows = []
    for d, name in ((events(spark, sf_dir), "value"), (embeddings(spark, sf_dir), "embedding")):
        rows.append((d.key, name, length_header(d.bind(name).parts[0].leaves[0].cells).hex()))
    return spark.createDataFrame(rows, "dataset string, variable string, header string")


@query("SELECT event_id::INT AS i_event, printf('%016x', user_id) AS wire FROM events")
def xdr_integers(spark, sf_dir):
    """The wire form of integers cell by cell, as Spark's own functions give it; floats are tested against numpy."""
    return only(events(spark, sf_dir), "user_id").select("i_event", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("wire"))


@query("SELECT vec_id::INT AS place, printf('%08x', label) AS word FROM embeddings")
def xdr_payload(spark, sf_dir):
    """The payload of a variable as tasks encode it, taken apart into words again."""
    d = embeddings(spark, sf_dir)
    leaf = d.bind("label").parts[0].leaves[0]
    word = encoded_rows(d.leaf(leaf), ["i_vec"], leaf.type, F.col("i_vec")).select("first", "payload", F.explode(F.sequence(F.lit(0), (F.octet_length("payload") / 4).cast("int") - 1)).alias("k"))
    return word.select((F.col("first") + F.col("k")).cast("int").alias("place"), F.lower(F.hex(F.substring("payload", (F.col("k") * 4 + 1).cast("int"), F.lit(4)))).alias("word"))


@query("SELECT dataset, variable, kind FROM (VALUES ('embeddings', 'vec', 'variable'), ('embeddings', 'dim', 'variable'), ('embeddings', 'embedding', 'grid'), ('embeddings', 'label', 'variable'), ('no dim', 'embedding', 'variable')) t(dataset, variable, kind)")
def classify_grids(spark, sf_dir):
    d = embeddings(spark, sf_dir)
    rows = [("embeddings", p.outer, p.kind) for p in d.bind().parts]
    lone = Schema("no dim", [Variable(v.name, v.type if v.name != "dim" else None, v.dims, v.shape) for v in d.schema.variables])
    rows += [("no dim", p.outer, p.kind) for p in lone.bind(()).parts if p.outer == "embedding"]
    return spark.createDataFrame(rows, "dataset string, variable string, kind string")

