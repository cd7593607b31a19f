"""Registered queries over member stores and stored numbering: tables cut in many members, read by one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.index import dense_index
from .queries import WIDTH, _CELLS, day, embeddings, events, only, query, read
from .session import shared_path
from .sources import cells_format
from .sources.base import Dataset, Together
from .sources.chunks import ChunkStore, write_store
from .sources.members import MemberStore, write_members
from .sources.snapshots import Snapshot, commit
from .sources.tables import TableSource
from .streaming import segments
from .streaming.member_table import follow, followed

_STORES: dict[tuple[str, str, str], str] = {}


def month_store(spark: SparkSession, sf_dir: str) -> str:
    """``orders`` with a member for each month, made once for a session; names of months don't sort as their days."""
    key = (spark.sparkContext.applicationId, sf_dir, "orders")
    if key not in _STORES:
        path = shared_path(spark, "months")
        rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
        write_members(path, rows, F.date_format("o_orderdate", "MM-yyyy"), "o_orderkey", "time", day(), ["price", "customer"], chunk_rows=256)
        _STORES[key] = path
    return _STORES[key]


def months(spark: SparkSession, sf_dir: str) -> MemberStore:
    return MemberStore(spark, month_store(spark, sf_dir))


def label_store(spark: SparkSession, sf_dir: str) -> Dataset:
    """``embeddings`` with a member for each label; vectors keep their number as coordinate."""
    key = (spark.sparkContext.applicationId, sf_dir, "embeddings")
    if key not in _STORES:
        path = shared_path(spark, "labels")
        write_members(path, read(spark, sf_dir, "embeddings"), F.col("label"), "vec_id", "vec", F.col("vec_id"), ["embedding"], {"embedding": ("dim", WIDTH)}, chunk_rows=64 * WIDTH)
        _STORES[key] = path
    dims = TableSource(spark.range(WIDTH).select("id", F.col("id").cast("int").alias("dim")), "dim", "id", coordinate="dim", length=WIDTH)
    return Dataset("vectors", Together(MemberStore(spark, _STORES[key]), dims))


_DAY = "date_diff('day', DATE '1970-01-01', o_orderdate::DATE)"
_MONTHS = f"""SELECT *, (row_number() OVER (ORDER BY rank, member) - 1)::INT AS ordinal, coalesce(sum(n) OVER (ORDER BY rank, member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS member_start
  FROM (SELECT strftime(o_orderdate, '%m-%Y') AS member, count(*) AS n, arg_min({_DAY}, o_orderkey)::DOUBLE AS rank FROM orders GROUP BY 1)"""
_ROWS = f"""SELECT (row_number() OVER (ORDER BY m.ordinal, o.o_orderkey) - 1)::INT AS i_time, o.o_totalprice AS price, o.o_custkey AS customer, {_DAY}::INT AS time, m.member
  FROM orders o JOIN ({_MONTHS}) m ON strftime(o.o_orderdate, '%m-%Y') = m.member"""
_MIDDLE = "(SELECT count(*) // 2 FROM orders)"


def middle(source: MemberStore) -> tuple[int, int]:
    """A range in the middle, of a thirtieth of the rows: a few members."""
    return source.total // 2, source.total // 30


@query(_MONTHS)
def members_opened(spark, sf_dir):
    """One job tells the size, first coordinate, place and start of every member."""
    return months(spark, sf_dir).members


@query(f"SELECT i_time, price AS value FROM ({_ROWS})")
def members_whole(spark, sf_dir):
    return only(Dataset("months", months(spark, sf_dir)), "price")


@query(f"SELECT i_time, customer AS value FROM ({_ROWS}) WHERE i_time >= {_MIDDLE} AND i_time < {_MIDDLE} + (SELECT count(*) // 30 FROM orders)")
def members_range(spark, sf_dir):
    source = months(spark, sf_dir)
    start, count = middle(source)
    return only(Dataset("months", source), f"customer[{start}:{start + count - 1}]")


@query(f"SELECT i_time, time AS value FROM ({_ROWS}) WHERE i_time >= {_MIDDLE} AND i_time < {_MIDDLE} + (SELECT count(*) // 30 FROM orders)")
def members_coordinate(spark, sf_dir):
    source = months(spark, sf_dir)
    start, count = middle(source)
    return only(Dataset("months", source), f"time[{start}:{start + count - 1}]")


@query(f"SELECT DISTINCT member FROM ({_ROWS}) WHERE i_time >= {_MIDDLE} AND i_time < {_MIDDLE} + (SELECT count(*) // 30 FROM orders)")
def members_read(spark, sf_dir):
    """The members whose files a range reads, by the files' own paths."""
    source = months(spark, sf_dir)
    scan = source.scan(source.schema().find("price")).select("member", F.regexp_extract(F.col("_metadata.file_path"), "/member=([^/]*)/", 1).alias("read"))
    return source.rows(scan, *middle(source)).select(F.col("read").alias("member")).distinct()


_VECTORS = f"""SELECT (row_number() OVER (ORDER BY rank, label::VARCHAR, vec_id) - 1)::INT AS i_vec, vec_id AS vec, embedding
  FROM (SELECT *, min(vec_id) OVER (PARTITION BY label) AS rank FROM embeddings)"""


@query(f"SELECT i_vec, d::INT AS i_dim, embedding[d + 1] AS value, vec, d::INT AS dim FROM ({_VECTORS}), range(5, 12) t(d) WHERE i_vec BETWEEN 30 AND 70")
def members_grid(spark, sf_dir):
    """A box over members with both maps."""
    return label_store(spark, sf_dir).grid("embedding[30:70][5:11]")


@query("SELECT (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1)::BIGINT AS i, l_orderkey, l_linenumber FROM lineitem")
def stored_numbering(spark, sf_dir) -> DataFrame:
    """All rows numbered by a stored, range-partitioned table and sums of its files' counts."""
    return dense_index(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def tiled(spark: SparkSession, sf_dir: str) -> str:
    """``embedding`` in chunks of 32 by 8, in the order of their numbers, made once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "tiled")
    if key not in _STORES:
        path = shared_path(spark, "tiled")
        write_store(path, embeddings(spark, sf_dir).source, only=["embedding"], chunks={"embedding": (32, 8)})
        _STORES[key] = path
    return _STORES[key]


@query(f"{_CELLS} WHERE d BETWEEN 17 AND 19")
def tiles_inner_range(spark, sf_dir):
    """A narrow range of the inner axis over all of the outer one: chunks beside it aren't read."""
    return only(Dataset("tiled", ChunkStore(spark, tiled(spark, sf_dir))), f"embedding[0:{embeddings(spark, sf_dir).source.length - 1}][17:19]")


@query("SELECT DISTINCT vec_id::INT // 32 AS c_0, d::INT // 8 AS c_1 FROM embeddings, range(64) t(d) WHERE vec_id BETWEEN 64 AND 127 AND d BETWEEN 32 AND 47")
def tiles_met(spark, sf_dir):
    """The chunks that the numbers' ranges give for a box that is a whole part of the grid: those of the box."""
    store = ChunkStore(spark, tiled(spark, sf_dir))
    return store.met(store.schema().find("embedding"), (64, 32), (64, 16)).select("c_0", "c_1")


def bucketed(spark: SparkSession, sf_dir: str) -> Dataset:
    """``embedding`` and the map ``vec`` bucketed alike by chunks of ``vec``, made once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "bucketed")
    if key not in _STORES:
        path = shared_path(spark, "bucketed")
        write_store(path, embeddings(spark, sf_dir).source, only=["embedding", "vec", "dim"], chunk_cells=1024, buckets={"embedding": ("vec", 8)})
        _STORES[key] = path
    return Dataset("bucketed", ChunkStore(spark, _STORES[key]), steps=True)


_GRID = f"SELECT i_vec, i_dim, value, i_vec::BIGINT AS vec, i_dim AS dim FROM ({_CELLS})"


@query(_GRID)
def bucketed_grid(spark, sf_dir):
    """All cells with both maps; neither the array nor its long map is moved."""
    return bucketed(spark, sf_dir).grid("embedding")


@query(f"{_GRID} WHERE i_vec BETWEEN 33 AND 90 AND i_dim BETWEEN 7 AND 55 AND (i_dim - 7) % 12 = 0")
def bucketed_grid_box(spark, sf_dir):
    return bucketed(spark, sf_dir).grid("embedding[33:90][7:12:55]")


@query("SELECT 1 AS version, event_id::INT AS i_event, value FROM events UNION ALL SELECT 3, event_id::INT, value * 2 FROM events UNION ALL SELECT 3, event_id::INT, user_id::DOUBLE FROM events")
def snapshot_versions(spark, sf_dir):
    """Cells of a version that was opened, but not read, before two commits, and of the version after them."""
    path, source = shared_path(spark, "versions"), events(spark, sf_dir).source
    old = Dataset("events", commit(spark, path, source, only=["value"]))
    before = only(old, "value")
    twice = TableSource(source.table.withColumn("value", F.col("value") * 2), "event", "event_id", length=source.length)
    commit(spark, path, twice, only=["value"], base=old.source)
    commit(spark, path, source, only=["user_id"], base=old.source)
    new = Dataset("events", Snapshot(spark, path))
    found = [(1, before), (3, only(new, "value")), (3, only(new, "user_id"))]
    parts = [df.select(F.lit(n).alias("version"), "i_event", F.col("value").cast("double").alias("value")) for n, df in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def chunked(spark: SparkSession, sf_dir: str) -> str:
    """``value`` of the events in chunks of 64, made once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "chunked")
    if key not in _STORES:
        path = shared_path(spark, "chunked")
        write_store(path, events(spark, sf_dir).source, only=["value"], chunk_cells=64)
        _STORES[key] = path
    return _STORES[key]


@query("SELECT event_id::INT AS i_event, value FROM events WHERE event_id >= 5 AND (event_id - 5) % 171 = 0")
def strided_box(spark, sf_dir):
    """Every 171st cell of a chunked variable: chunks that the steps pass over aren't taken apart."""
    d = Dataset("chunked", ChunkStore(spark, chunked(spark, sf_dir)), steps=True)
    return only(d, f"value[5:171:{d.schema.find('value').shape[0] - 1}]")


@query("SELECT DISTINCT event_id::INT // 64 AS c_0 FROM events WHERE event_id >= 5 AND (event_id - 5) % 171 = 0")
def strided_chunks(spark, sf_dir):
    """The chunks that it takes apart: those with a cell of it."""
    store = ChunkStore(spark, chunked(spark, sf_dir))
    v = store.schema().find("value")
    return store.hit(v, (5,), ((v.shape[0] - 6) // 171 + 1,), (171,)).select("c_0")


@query(f"SELECT i_vec, i_dim, value FROM ({_CELLS}) WHERE i_vec >= 3 AND (i_vec - 3) % 70 = 0 AND i_dim BETWEEN 1 AND 61 AND (i_dim - 1) % 20 = 0")
def strided_tiles(spark, sf_dir):
    """Steps in both axes over chunks in the order of their numbers."""
    d = Dataset("tiled", ChunkStore(spark, tiled(spark, sf_dir)), steps=True)
    return only(d, f"embedding[3:70:{d.schema.find('embedding').shape[0] - 1}][1:20:61]")


@query("SELECT event_id::INT AS i_event, value FROM events WHERE event_id BETWEEN 10 AND 900 AND (event_id - 10) % 7 = 0")
def strided_table(spark, sf_dir):
    source = events(spark, sf_dir).source
    return only(Dataset("events", source, steps=True), "value[10:7:900]")


@query(f"SELECT i_dim, count(*) AS n, sum(value::DOUBLE) > 0 AS positive FROM ({_CELLS}) WHERE i_vec BETWEEN 40 AND 90 AND i_dim > 60 GROUP BY 1")
def cells_format_where(spark, sf_dir):
    """A predicate on indices in Spark's SQL, as a box of the data source."""
    cells_format.register(spark)
    cells = spark.read.format("array_cells").load(tiled(spark, sf_dir)).where("i_vec BETWEEN 40 AND 90 AND i_dim > 60")
    return cells.groupBy("i_dim").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("value").cast("double")) > 0).alias("positive"))


@query("SELECT vec_id::INT AS place, printf('%08x', label) AS word FROM embeddings")
def segments_payload(spark, sf_dir):
    """A data response written by tasks: the words of its segments, read by tasks again."""
    path = shared_path(spark, "response")
    segments.write_dods(embeddings(spark, sf_dir), "label", path)
    found = segments.stored_payload(spark, path, 0)
    word = found.select("first", "payload", F.explode(F.sequence(F.lit(0), (F.octet_length("payload") / 4).cast("int") - 1)).alias("k"))
    return word.select((F.col("first") / 4 + F.col("k")).cast("int").alias("place"), F.lower(F.hex(F.substring("payload", (F.col("k") * 4 + 1).cast("int"), F.lit(4)))).alias("word"))


@query(_MONTHS)
def members_followed(spark, sf_dir):
    """The member table of a store that grew by three appends, as a stream of its files keeps it."""
    path, counts = shared_path(spark, "growing"), shared_path(spark, "counts")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    for k, years in enumerate(((1994, 9999), (0, 1992), (1993, 1993))):
        write_members(path, rows.where(F.year("o_orderdate").between(*years)), F.date_format("o_orderdate", "MM-yyyy"), "o_orderkey", "time", day(), ["time"], append=k > 0)
        follow(spark, path, counts, f"{counts}-checkpoint").awaitTermination()
    return followed(spark, counts)
