"""Datasets joined along an existing outermost dimension, and the XML files that describe them."""

from __future__ import annotations

import math
import os
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import Attribute
from ..operators.coordinate import LONGEST, segment_cells, segments
from ..operators.join_existing import Piece, pieces
from ..operators.slab import index_type
from ..plans.schema import Schema, Variable
from ..session import delete, plain, shared_path
from .base import ArraySource
from .chunks import SCHEMA_FILE, ChunkStore, chunk_rows, store_of, store_stamps, taken_apart

#: Of more stores than this a job lists when they were changed; of fewer the driver asks for each.
LISTED = 32


class JoinedSource(ArraySource):
    """Members in the order of their first coordinate; the first gives schema and attributes.

    Variables whose first dimension isn't ``dim`` come from the first member. The
    coordinate is read once and kept as segments; overlaps and repeats stay. Members that are
    chunk stores alike in types and chunks are read by one scan, however many they are.
    """

    def __init__(self, members: list[ArraySource], dim: str, stamp: Callable[[], object] | None = None):
        if not members:
            raise ValueError("no members")
        lengths = [m.schema().find(dim).shape[0] for m in members]
        for k, n in enumerate(lengths):
            if not n:
                raise ValueError(f"member {k} has no {dim}")
        if alike(members, dim):
            heads = first_values(members, dim)
        else:
            heads = reduce(DataFrame.unionByName, [m.cells(dim, (0,), (1,)).select(F.lit(k).alias("k"), F.col("value").cast("double").alias("rank")) for k, m in enumerate(members)])
        found = {r["k"]: r["rank"] for r in heads.collect()}  # a row for each member, one job
        known = [k for k in range(len(members)) if not math.isnan(found[k])]
        order = sorted(range(len(members)), key=lambda k: found[k]) if len(known) == len(members) else _insertion(members, found)
        self.members = [members[k] for k in order]
        self.sizes = [lengths[k] for k in order]
        self.ranks = [found[k] for k in order]
        self.dim, self._stamp = dim, stamp
        first = self.members[0].schema()
        self._schema = Schema("", [self._longer(v) for v in first.variables])

    def _longer(self, v: Variable) -> Variable:
        return Variable(v.name, v.type, v.dims, (sum(self.sizes), *v.shape[1:])) if self.joins(v) else v

    def joins(self, v: Variable) -> bool:
        return bool(v.dims) and v.dims[0] == self.dim

    def schema(self) -> Schema:
        return self._schema

    def listed(self) -> list[str]:
        return self.members[0].listed()

    def attributes(self) -> dict[str | None, list[Attribute]]:
        return self.members[0].attributes()

    def stamp(self) -> object:
        own = self._stamp() if self._stamp else None
        if len(self.members) > LISTED and all(isinstance(m, ChunkStore) for m in self.members):
            return (own, store_stamps(self.members[0].spark, [m.path for m in self.members]))
        return (own, tuple(m.stamp() for m in self.members))

    @cached_property
    def coordinate(self) -> DataFrame:
        """The joined coordinate as segments, found once and written to the shared folder: a row for each 65,536 values at most."""
        v, total = self._schema.find(self.dim), sum(self.sizes)
        if alike(self.members, self.dim):
            chunk = self.members[0].chunk[self.dim][0]
            rows = self._chunks(v, self.members, pieces(self.sizes, 0, total))
            stretches = rows.select((F.col("member_start") + F.col("c_0").cast("long") * chunk).alias("at"), "payload")
        else:
            rows = chunk_rows(self._joined(self.dim, (0,), (total,)), v, (LONGEST,))
            stretches = rows.select((F.col("c_0").cast("long") * LONGEST).alias("at"), "payload")
        found = segments(stretches, v.type.spark)
        spark, self._kept = found.sparkSession, shared_path(found.sparkSession, "coordinate")
        found.write.parquet(self._kept)
        return spark.read.schema(found.schema).parquet(self._kept)

    def close(self) -> None:
        if kept := self.__dict__.pop("coordinate", None):
            delete(kept.sparkSession, self._kept)
        for m in self.members:
            m.close()

    def cells(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> DataFrame:
        v = self._schema.find(name)
        if not self.joins(v):
            return self.members[0].cells(name, starts, counts)
        if name == self.dim:
            return segment_cells(self.coordinate, f"i_{self.dim}", index_type(sum(self.sizes)), v.type.spark, starts[0], counts[0])
        return self._joined(name, starts, counts)

    def runs(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> Iterator[DataFrame] | None:
        """Members' runs one after the other, if all that are touched have them; places count in each member."""
        if not self.joins(self._schema.find(name)):
            return self.members[0].runs(name, starts, counts)
        parts = pieces(self.sizes, starts[0], counts[0])
        found = [self.members[p.ordinal].runs(name, (p.start, *starts[1:]), (p.count, *counts[1:])) for p in parts]
        if not found or any(f is None for f in found):
            return None
        return chain.from_iterable(found)

    def _joined(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> DataFrame:
        """Members that the range doesn't touch aren't in the plan at all."""
        v = self._schema.find(name)
        axis, touched = f"i_{v.axes[0]}", pieces(self.sizes, starts[0], counts[0])
        own = [self.members[p.ordinal] for p in touched]
        if touched and alike(own, name):
            return taken_apart(self._chunks(v, own, touched), v, own[0].chunk[name], starts, counts, F.col("n"), F.col("member_start"))
        parts = [
            self.members[p.ordinal].cells(name, (p.start, *starts[1:]), (p.count, *counts[1:])).withColumn(axis, (F.col(axis).cast("long") + p.offset).cast(index_type(sum(self.sizes))))
            for p in touched
        ]
        if not parts:
            return self.members[0].cells(name, (0, *starts[1:]), (0, *counts[1:])).limit(0)
        return reduce(DataFrame.unionByName, parts)

    def _chunks(self, v: Variable, own: list[ChunkStore], touched: list[Piece]) -> DataFrame:
        """Chunks of stores that lie anywhere, by one scan; a small table says where each begins in the whole."""
        spark = own[0].spark
        begin = spark.createDataFrame([(plain(m.path), self.sizes[p.ordinal], p.offset) for m, p in zip(own, touched, strict=True)], "of string, n long, member_start long")
        # a member may be listed twice: its chunks are read once and have a row for each
        return own[0].rows(v, [m.path for m in own]).withColumn("store", store_of(F.col("_metadata.file_path"))).join(F.broadcast(begin), F.col("store") == F.col("of"))


def alike(members: list[ArraySource], name: str) -> bool:
    """Are all of them chunk stores that can be read by one scan of a variable?"""
    if not all(isinstance(m, ChunkStore) and name in m.chunk for m in members):
        return False
    of = {(m.chunk[name], m.schema().find(name).type.name, m.schema().find(name).shape[1:]) for m in members}
    return len(of) == 1


def first_values(stores: list[ChunkStore], dim: str) -> DataFrame:
    """``k, rank``: the first value of each store's coordinate, by one scan of first chunks."""
    spark = stores[0].spark
    rows = stores[0].rows(stores[0].schema().find(dim), [m.path for m in stores]).where("c_0 = 0")
    heads = rows.select(store_of(F.col("_metadata.file_path")).alias("store"), F.get("payload", F.lit(0)).cast("double").alias("rank"))
    own = spark.createDataFrame([(k, plain(m.path)) for k, m in enumerate(stores)], "k int, of string")
    return heads.join(F.broadcast(own), F.col("store") == F.col("of")).select("k", "rank")


def _insertion(members: list[ArraySource], rank: dict[int, float]) -> list[int]:
    """A stable order in which a rank that isn't a number counts as equal to any other."""
    out: list[int] = []
    for k in range(len(members)):
        at = len(out)
        while at and rank[out[at - 1]] > rank[k]:
            at -= 1
        out.insert(at, k)
    return out


class DescriptionError(ValueError):
    """The file doesn't describe an aggregation that is supported."""


def read_description(path: str) -> tuple[str, list[str]]:
    """The dimension and the member files of an XML description.

    The root's first child must be an ``aggregation`` of type ``joinExisting`` with a
    ``dimName``. Its children are ``netcdf`` (a file) and ``scan`` (files below a folder
    whose path ends with ``suffix`` and doesn't have ``ignore`` in it); those without a
    location, and other tags, say nothing.
    """
    local = lambda e: e.tag.rpartition("}")[2]
    try:
        first = next(iter(ET.parse(path).getroot()), None)
    except ET.ParseError as e:
        raise DescriptionError(f"{path}: {e}") from e
    if first is None or local(first) != "aggregation":
        raise DescriptionError(f"{path}: the first tag must be an aggregation")
    if first.get("type") != "joinExisting":
        raise DescriptionError(f"{path}: only joinExisting is supported, not {first.get('type')}")
    dim = first.get("dimName")
    if dim is None:
        raise DescriptionError(f"{path}: no dimName")
    base, out = os.path.dirname(path), []
    for e in first:
        location = e.get("location")
        if location is None or local(e) not in ("netcdf", "scan"):
            continue
        place = os.path.join(base, location)
        if local(e) == "netcdf":
            out.append(place)
        elif e.get("suffix") is None:
            raise DescriptionError(f"{path}: a scan without suffix")
        else:
            out += scan_members(place, e.get("suffix"), e.get("ignore"))
    return dim, out


def scan_members(folder: str, suffix: str, ignore: str | None = None) -> Iterator[str]:
    """Real paths of the files (or chunk stores) below a folder; hidden names are skipped, the folder's own too."""
    own = os.path.basename(folder.rstrip("/").removesuffix("/."))
    if own.startswith(".") and own not in (".", ".."):
        return
    for top, folders, files in os.walk(folder, followlinks=True):
        stores = [d for d in folders if os.path.exists(os.path.join(top, d, SCHEMA_FILE))]
        folders[:] = sorted(d for d in folders if not d.startswith(".") and d not in stores)
        for name in sorted([*files, *stores]):
            path = os.path.join(top, name)
            if not name.startswith(".") and path.endswith(suffix) and not (ignore is not None and ignore in path):
                yield os.path.realpath(path)
