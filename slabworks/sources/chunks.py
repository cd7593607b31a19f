"""Chunk stores: arrays as Parquet, one row for each chunk, with their schema beside them.

A variable's rows are in ``variable=<name>``, sorted by chunk, so a box prunes by
partition, by row-group statistics and by the pushed-down chunk predicate; only chunks
that it meets are taken apart into cells.

A variable may be bucketed by its chunk numbers of one axis, as is the map of that axis:
a grid's cells then get the map's values bucket by bucket, and the array isn't moved.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import Attribute
from ..operators import zorder
from ..operators import grid
from ..operators.slab import chunks_hit, covering, index_type, pick, restrict
from ..plans.schema import TYPES, Leaf, Schema, Variable
from ..session import modified, plain, read_text, write_text
from .base import ArraySource

SCHEMA_FILE = "schema.json"
#: Cells that the driver holds while it streams chunks that are stored in order.
RUN_CELLS = 1 << 22

#: Rows of a page where chunks lie by their Z-numbers: what a range reads besides its own.
PAGES = {"parquet.page.row.count.limit": "4"}


def grid_of(shape: tuple[int, ...], chunk: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(max(1, -(-n // c)) for n, c in zip(shape, chunk, strict=True))


def chunk_rows(cells: DataFrame, v: Variable, chunk: tuple[int, ...]) -> DataFrame:
    """``variable, c_<k>…, payload``: the cells of each chunk in row-major order; a chunk bounds what is gathered."""
    at = [F.col(f"i_{a}") for a in v.axes]
    where = [F.floor(i / n).cast("int").alias(f"c_{k}") for k, (i, n) in enumerate(zip(at, chunk, strict=True))]
    extent = [F.least(F.lit(n), F.lit(size) - F.floor(i / n) * n) for i, n, size in zip(at, chunk, v.shape, strict=True)]
    place = F.lit(0)
    for i, n, e in zip(at, chunk, extent, strict=True):
        place = place * e + i % n
    rows = cells.select(*where, F.struct(place.cast("int").alias("at"), F.col("value").cast(v.type.spark).alias("value")).alias("cell"))
    grouped = rows.groupBy(*[f"c_{k}" for k in range(len(chunk))]).agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return grouped.select(*[f"c_{k}" for k in range(len(chunk))], F.transform("cells", lambda c: c["value"]).alias("payload"))


def cut(v: Variable, cells: int) -> tuple[int, ...]:
    """A chunk of so many cells, whole in the inner dimensions first."""
    chunk, left = [], cells
    for k, n in reversed(list(enumerate(v.shape))):
        chunk.insert(0, max(1, min(n, left) if k else left))  # of the outermost alike in stores of any length
        left //= max(1, chunk[0])
    return tuple(chunk)


def table_name(path: str, own: dict) -> str:
    """The catalog's name for a bucketed variable's files; another layout at a path has another name."""
    return "slabworks_" + hashlib.md5(f"{plain(path)}\n{json.dumps(own, sort_keys=True)}".encode()).hexdigest()


def write_store(path: str, source: ArraySource, chunk_cells: int = 65_536, only: list[str] | None = None, chunks: dict[str, tuple[int, ...]] | None = None, buckets: dict[str, tuple[str, int]] | None = None) -> None:
    """Write variables of a source as a chunk store; chunks are cut along the outer dimensions first.

    ``chunks`` gives the chunks of variables that are asked for by boxes in any axis:
    those lie in the order of their Z-numbers, a few to a page, so near ones are read together.

    ``buckets`` gives the dimension of a grid's array, and a number, by whose chunks the
    array and that dimension's map are bucketed. All its maps are cut as it is. Each
    bucket is written by one task; choose their number so that one is of some hundred MB.
    """
    schema, attributes = source.schema(), source.attributes()
    cuts = {v.name: cut(v, chunk_cells) for v in schema.variables} | {name: tuple(c) for name, c in (chunks or {}).items()}
    bucketed: dict[str, tuple[str, int]] = {}
    fixed = {name: tuple(c) for name, c in (chunks or {}).items()}
    for name, (dim, n) in (buckets or {}).items():
        v = schema.find(name)
        if not schema.gridded(v) or dim not in v.dims:
            raise ValueError(f"{name} isn't a grid over {dim}")
        for d, size in zip(v.dims, cuts[name], strict=True):
            if fixed.setdefault(d, (size,)) != (size,):
                raise ValueError(f"{d} is cut in two ways")
            cuts[d] = (size,)
        if bucketed.setdefault(dim, ("c_0", n)) != ("c_0", n):
            raise ValueError(f"{dim} has two numbers of buckets")
        bucketed[name] = (f"c_{v.dims.index(dim)}", n)
    book = {"variables": [], "listed": source.listed(), "attributes": [[name, [[a.name, a.type, list(a.values)] for a in own]] for name, own in attributes.items()]}
    for v in schema.variables:
        if only is not None and v.name not in only:
            continue
        chunk, ordered = list(cuts[v.name]), v.name in (chunks or {})
        rows = chunk_rows(source.cells(v.name, (0,) * len(v.shape), v.shape), v, tuple(chunk))
        keys = [f"c_{k}" for k in range(len(chunk))]
        own = {"name": v.name, "type": v.type.name, "dims": list(v.dims), "shape": list(v.shape), "chunk": chunk}
        if ordered:
            rows = rows.withColumn("z", zorder.number([F.col(k) for k in keys], grid_of(v.shape, tuple(chunk))))
            keys, own["z"] = ["z"], True
        book["variables"].append(own)
        if v.name in bucketed:
            key, n = own["bucket"] = bucketed[v.name]
            writer = rows.repartition(n, key).write.format("parquet").options(**(PAGES if ordered else {}))
            at = f"{path}/variable={v.name}"
            writer.bucketBy(n, key).sortBy(*dict.fromkeys([key, *keys])).options(path=at, ignoreMissingFiles="false").saveAsTable(table_name(at, own))
            continue
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows
        rows.write.options(**(PAGES if ordered else {})).parquet(f"{path}/variable={v.name}")
    write_text(rows.sparkSession, f"{path}/{SCHEMA_FILE}", json.dumps(book))


def store_of(path: Column) -> Column:
    """The store that a file of a variable lies in, as ``session.plain`` spells it."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/variable=[^/]*/.*$", 1), "^file:/+", "/")


def open_stores(spark: SparkSession, paths: list[str]) -> list[ChunkStore]:
    """Many stores opened by one job: their schema files are read by tasks, a row for each store comes to the driver."""
    files = spark.read.format("binaryFile").load([f"{p}/{SCHEMA_FILE}" for p in dict.fromkeys(paths)])
    rows = files.select("path", "modificationTime", F.col("content").cast("string").alias("text")).collect()
    found = {plain(r["path"]).removesuffix(f"/{SCHEMA_FILE}"): r for r in rows}
    return [ChunkStore(spark, p, json.loads(found[plain(p)]["text"])) for p in paths]


def store_stamps(spark: SparkSession, paths: list[str]) -> tuple:
    """What ``ChunkStore.stamp`` tells of many stores, by one listing."""
    files = spark.read.format("binaryFile").load([f"{p}/{SCHEMA_FILE}" for p in dict.fromkeys(paths)])
    return tuple(sorted((plain(r["path"]), r["at"]) for r in files.select("path", F.unix_millis("modificationTime").alias("at")).collect()))


def taken_apart(rows: DataFrame, v: Variable, chunk: tuple[int, ...], starts: tuple[int, ...], counts: tuple[int, ...], length: Column | None = None, offset: Column | None = None, beside: dict[int, str] | None = None) -> DataFrame:
    """The cells of a box, of rows of chunks; only chunks that it meets are taken apart.

    Where chunks are of members of a joined array, ``length`` is the member's extent of
    the outermost axis and ``offset`` its first index in the whole. ``beside`` names the maps
    of some axes: their values in the chunk are in the columns ``map_<k>``, and cells get theirs.
    """
    if not all(counts):
        rows = rows.limit(0)
    begin = F.lit(starts[0]) - (F.lit(0) if offset is None else offset) if chunk else F.lit(0)
    for k, (start, count, n, size) in enumerate(zip(starts, counts, chunk, v.shape, strict=True)):
        if not all(counts) or count == size:
            continue
        if k or offset is None:
            rows = rows.where(F.col(f"c_{k}").between(start // n, (start + count - 1) // n))
        else:
            rows = rows.where(((F.col("c_0").cast("long") + 1) * n > begin) & (F.col("c_0").cast("long") * n < begin + count))
    sizes = [F.lit(size) for size in v.shape]
    if length is not None:
        sizes[0] = length
    extents = [F.least(F.lit(n), size - F.col(f"c_{k}").cast("long") * n).cast("int") for k, (n, size) in enumerate(zip(chunk, sizes, strict=True))]
    skip, payload = F.lit(0), F.col("payload")
    if chunk and counts[0] != v.shape[0]:  # of the outermost axis only the rows in the box are taken out of the payload
        inner, first = reduce(Column.__mul__, extents[1:], F.lit(1)), F.col("c_0").cast("long") * chunk[0]
        low = F.greatest(F.lit(0), begin - first)
        high = F.least(extents[0], begin + counts[0] - first)
        skip, payload = (low * inner).cast("int"), F.slice("payload", (low * inner + 1).cast("int"), F.greatest(F.lit(0), (high - low) * inner).cast("int"))
    kept = [] if length is None else [length.alias("n"), offset.alias("member_start")]
    rows = rows.select(*[f"c_{k}" for k in range(len(chunk))], *kept, *(f"map_{k}" for k in beside or {}), skip.alias("skip"), F.posexplode(payload).alias("at", "value"))
    left, index, values = F.col("at") + F.col("skip"), [], []
    for k in reversed(range(len(chunk))):
        extent = extents[k]
        at = F.col(f"c_{k}").cast("long") * chunk[k] + left % extent + (F.col("member_start") if kept and not k else 0)
        index.insert(0, at.cast(index_type(v.shape[k])).alias(f"i_{v.axes[k]}"))
        if k in (beside or {}):
            values.insert(0, F.get(F.col(f"map_{k}"), (left % extent).cast("int")).alias(beside[k]))
        left = F.floor(left / extent)
    cells = rows.select(*index, "value", *values)
    return restrict(cells, v.axes, starts, counts, v.shape) if all(counts) else cells


class ChunkStore(ArraySource):
    """A chunk store on disk."""

    def __init__(self, spark: SparkSession, path: str, book: dict | None = None):
        book = book or json.loads(read_text(spark, f"{path}/{SCHEMA_FILE}"))
        self.spark, self.path, self.book = spark, path, book
        self.chunk = {v["name"]: tuple(v["chunk"]) for v in book["variables"]}
        self.numbered = {v["name"] for v in book["variables"] if v.get("z")}
        self.bucketed = {v["name"]: v for v in book["variables"] if v.get("bucket")}
        self._schema = Schema("", [Variable(v["name"], TYPES[v["type"]], tuple(v["dims"]), tuple(v["shape"])) for v in book["variables"]])

    def schema(self) -> Schema:
        return self._schema

    def listed(self) -> list[str]:
        return self.book["listed"]

    def attributes(self) -> dict[str | None, list[Attribute]]:
        return {name: [Attribute(a, kind, tuple(values)) for a, kind, values in own] for name, own in self.book["attributes"]}

    def stamp(self) -> object:
        return modified(self.spark, f"{self.path}/{SCHEMA_FILE}")

    def columns(self, v: Variable) -> str:
        keys = "".join(f"c_{k} int, " for k in range(len(self.chunk[v.name])))
        number = "z bigint, " if v.name in self.numbered else ""
        return f"{keys}{number}payload array<{v.type.spark}>"

    def rows(self, v: Variable, stores: list[str] | None = None) -> DataFrame:
        """A variable's chunks: ``c_<k>…, payload``; with ``stores``, those of other stores that are cut alike."""
        return self.spark.read.schema(self.columns(v)).option("ignoreMissingFiles", "false").parquet(*[f"{p}/variable={v.name}" for p in dict.fromkeys(stores or [self.path])])

    def table(self, v: Variable) -> DataFrame:
        """A bucketed variable's chunks, as a table that tells how they are bucketed.

        The catalog keeps an external table for each such variable until ``close``.
        """
        own, path = self.bucketed[v.name], f"{self.path}/variable={v.name}"
        name, (key, n) = table_name(path, own), own["bucket"]
        if not self.spark.catalog.tableExists(name):
            order = ["z"] if v.name in self.numbered else [f"c_{k}" for k in range(len(v.shape))]
            at = path.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({self.columns(v)}) USING parquet OPTIONS (ignoreMissingFiles 'false') "
                f"CLUSTERED BY ({key}) SORTED BY ({', '.join(dict.fromkeys([key, *order]))}) INTO {n} BUCKETS LOCATION '{at}'"
            )
        return self.spark.table(name)

    def close(self) -> None:
        for v in self.bucketed.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table_name(f'{self.path}/variable={v["name"]}', v)}")

    def gridded(self, array: Leaf, maps: list[Leaf]) -> DataFrame | None:
        """Chunks of a bucketed array meet those of its maps before they are taken apart.

        The map of the bucketed axis meets it bucket by bucket, without an exchange.
        Others are broadcast up to ``BROADCAST_CELLS``; of longer ones the chunks, not the
        cells, are shuffled.
        """
        v, chunk = self._schema.find(array.name), self.chunk[array.name]
        if v.name not in self.bucketed or not all(array.counts) or any(self.chunk[m.name] != (n,) for m, n in zip(maps, chunk, strict=True)):
            return None
        steps = array.steps or (1,) * len(chunk)
        counts, (key, buckets) = covering(array.counts, steps), self.bucketed[v.name]["bucket"]
        rows = self.hit(v, array.starts, array.counts, steps, self.table(v))
        sides = []
        for k, (m, start, count, n) in enumerate(zip(maps, array.starts, counts, chunk, strict=True)):
            own, joined = self._schema.find(m.name), key == f"c_{k}" and self.bucketed.get(m.name, {}).get("bucket") == ["c_0", buckets]
            side = (self.table(own) if joined else self.rows(own)).where(F.col("c_0").between(start // n, (start + count - 1) // n))
            side = side.select(F.col("c_0").alias(f"c_{k}"), F.col("payload").alias(f"map_{k}"))
            if joined:  # a bucket of the map is hashed if it is small; else both are sorted
                side = side.hint("shuffle_hash" if v.shape[k] <= buckets * grid.BROADCAST_CELLS else "merge")
            elif count <= grid.BROADCAST_CELLS:
                side = F.broadcast(side)
            sides.append((not joined, k, side))
        for _, k, side in sorted(sides, key=lambda s: s[:2]):  # the bucketed one first, while the buckets are as they were
            rows = rows.join(side, f"c_{k}")
        cells = taken_apart(rows, v, chunk, array.starts, counts, beside={k: m.name for k, m in enumerate(maps)})
        return pick(cells, v.axes, array.starts, steps)

    def runs(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> Iterator[DataFrame] | None:
        """A box that is a run of the outermost dimension, where chunks are that as well: some chunks at a time, told to the scan."""
        v, chunk = self._schema.find(name), self.chunk[name]
        if not chunk or name in self.numbered or chunk[1:] != v.shape[1:] or counts[1:] != v.shape[1:] or not prod(counts):
            return None
        inner, step = prod(v.shape[1:]), max(1, RUN_CELLS // prod(chunk))
        last = (starts[0] + counts[0] - 1) // chunk[0]

        def some(low: int) -> DataFrame:
            rows = self.rows(v).where(F.col("c_0").between(low, min(last, low + step - 1)))
            first = F.col("c_0").cast("long") * chunk[0]
            begin, end = F.greatest(first, F.lit(starts[0])), F.least(first + chunk[0], F.lit(min(v.shape[0], starts[0] + counts[0])))
            return rows.select(((begin - starts[0]) * inner).alias("place"), F.slice("payload", ((begin - first) * inner + 1).cast("int"), ((end - begin) * inner).cast("int")).alias("values"))

        return map(some, range(starts[0] // chunk[0], last + 1, step))

    def cells(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> DataFrame:
        v = self._schema.find(name)
        return taken_apart(self.met(v, starts, counts), v, self.chunk[name], starts, counts)

    def strided(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...], steps: tuple[int, ...]) -> DataFrame:
        v = self._schema.find(name)
        cells = taken_apart(self.hit(v, starts, counts, steps), v, self.chunk[name], starts, covering(counts, steps))
        return pick(cells, v.axes, starts, steps)

    def hit(self, v: Variable, starts: tuple[int, ...], counts: tuple[int, ...], steps: tuple[int, ...], rows: DataFrame | None = None) -> DataFrame:
        """A variable's chunks, without those that the steps pass over."""
        rows = self.met(v, starts, covering(counts, steps), rows)
        for k, (start, count, step, n) in enumerate(zip(starts, counts, steps, self.chunk[v.name], strict=True)):
            found = chunks_hit(F.col(f"c_{k}"), start, count, step, n)
            rows = rows if found is None else rows.where(found)
        return rows

    def met(self, v: Variable, starts: tuple[int, ...], counts: tuple[int, ...], rows: DataFrame | None = None) -> DataFrame:
        """A variable's chunks, without those that their numbers tell to lie outside a box."""
        rows, chunk = self.rows(v) if rows is None else rows, self.chunk[v.name]
        if v.name not in self.numbered or counts == v.shape or not all(counts):
            return rows
        low, high = tuple(s // n for s, n in zip(starts, chunk, strict=True)), tuple((s + c - 1) // n for s, c, n in zip(starts, counts, chunk, strict=True))
        found = zorder.ranges(low, high, grid_of(v.shape, chunk))
        return rows.where(reduce(Column.__or__, [F.col("z").between(a, b) for a, b in found]))
