"""Member stores: arrays joined along their outermost dimension, a partition for each member, read by one scan.

``variable=<name>/member=<member>/`` holds the chunks of a member's own array. Where a
member begins in the whole is a small table, found by one job and joined to the chunks;
the members that a range touches reach the scan by dynamic partition pruning, so no plan
grows with the number of members and no list of them visits the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import Attribute
from ..functions.index import dense_index
from ..operators.join_existing import BROADCAST_MEMBERS, member_offsets
from ..plans.schema import TYPES, Schema, Variable, type_of_spark
from ..session import modified, read_text, shared_path, write_text
from . import chunks
from .base import ArraySource
from .chunks import SCHEMA_FILE, taken_apart


def write_members(
    path: str,
    table: DataFrame,
    member: Column,
    order: str,
    dim: str,
    coordinate: Column,
    variables: list[str],
    inner: dict[str, tuple[str, int]] | None = None,
    chunk_rows: int = 65_536,
    attributes: dict[str | None, list[Attribute]] | None = None,
    append: bool = False,
) -> None:
    """Write the members of a table, or add members to a store.

    Rows of a member are its places in the order of the column ``order``, which no two
    of its rows share; ``coordinate`` is the joined dimension's variable. ``variables``
    are number columns, or lists of numbers along the dimension that ``inner`` gives with
    its length. A member is numbered and cut into chunks by many tasks, however large it
    is. A row without a member is an error, as is adding a member that is there.
    """
    spark, inner = table.sparkSession, inner or {}
    name = F.when(member.isNull(), F.raise_error(F.lit("a row without a member")).cast("string")).otherwise(member.cast("string"))
    rows = table.select(name.alias("member"), F.col(order).alias("__order"), coordinate.alias(dim), *[v for v in variables if v != dim])
    kinds = dict(rows.dtypes)
    found = []
    for v in dict.fromkeys([dim, *variables]):
        own = ((dim, 0), *([inner[v]] if v in inner else []))
        kind = type_of_spark(kinds[v].removeprefix("array<").removesuffix(">"))
        if kind is None:
            raise ValueError(f"{v}: {kinds[v]} isn't served")
        chunk = [max(1, chunk_rows // prod(n for _, n in own[1:])), *(n for _, n in own[1:])]
        found.append({"name": v, "type": kind.name, "dims": [d for d, _ in own], "shape": [n for _, n in own], "chunk": chunk})
    book = {"dim": dim, "variables": found, "attributes": [[k, [[a.name, a.type, list(a.values)] for a in own]] for k, own in (attributes or {None: []}).items()]}
    if append:
        before = json.loads(read_text(spark, f"{path}/{SCHEMA_FILE}"))
        if before["variables"] != book["variables"] or before["dim"] != dim:
            raise ValueError("the members have other variables than the store")
        there = spark.read.schema("member string").parquet(f"{path}/variable={dim}").select(F.col("member").alias("of"))
        if again := rows.join(there.distinct(), F.col("member") == F.col("of"), "left_semi").select("member").first():
            raise ValueError(f"member {again[0]} is in the store")
        book = before
    numbered = dense_index(rows, ["member", "__order"], "__i")
    first = numbered.groupBy("member").agg(F.min("__i").alias("__first")).withColumnRenamed("member", "__m")
    numbered = numbered.join(first, F.col("member") == F.col("__m")).withColumn("__k", F.col("__i") - F.col("__first"))
    for v in sorted(found, key=lambda v: v["name"] == dim):  # the coordinate last: whoever sees it finds the rest
        n = v["chunk"][0]
        cell = F.struct((F.col("__k") % n).cast("int").alias("at"), F.col(v["name"]).alias("value"))
        made = numbered.select("member", F.floor(F.col("__k") / n).cast("int").alias("c_0"), cell.alias("cell")).groupBy("member", "c_0").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
        payload = F.transform("cells", lambda c: c["value"])
        if v["name"] in inner:
            payload = F.flatten(payload)
        keys = [F.col("c_0"), *[F.lit(0).alias(f"c_{k}") for k in range(1, len(v["dims"]))]]
        made = made.select("member", *keys, payload.alias("payload")).repartitionByRange("member", "c_0").sortWithinPartitions("member", "c_0")
        made.write.mode("append" if append else "errorifexists").partitionBy("member").parquet(f"{path}/variable={v['name']}")
    write_text(spark, f"{path}/{SCHEMA_FILE}", json.dumps(book))


def opened(spark: SparkSession, path: str, book: dict) -> DataFrame:
    """``member, n, rank, ordinal, member_start`` of each member, by one job that reads the coordinate's chunks.

    Members are ordered by their first coordinate (one that isn't a number comes last), then by name.
    """
    return merged(partial_stats(spark.read.schema(coordinate_schema(book)).parquet(f"{path}/variable={book['dim']}")))


def coordinate_schema(book: dict) -> str:
    dim = next(v for v in book["variables"] if v["name"] == book["dim"])
    return f"c_0 int, payload array<{TYPES[dim['type']].spark}>, member string"


def partial_stats(rows: DataFrame) -> DataFrame:
    """``member, n, head``: of some of the coordinate's chunks, the members' rows, and the first chunk with its first value."""
    head = F.struct("c_0", F.get("payload", F.lit(0)).cast("double").alias("rank"))
    return rows.groupBy("member").agg(F.sum(F.size("payload")).alias("n"), F.min(head).alias("head"))


def merged(partial: DataFrame) -> DataFrame:
    """The member table, of partial counts that together cover each chunk once."""
    return member_offsets(partial.groupBy("member").agg(F.sum("n").alias("n"), F.min("head").alias("head")).select("member", "n", F.col("head.rank").alias("rank")))


class MemberStore(ArraySource):
    """The members of a store as one dataset.

    Its variables all have the joined dimension; others, such as those of inner
    dimensions, are put beside it by ``base.Together``. Overlaps and repeats of
    coordinates stay.
    """

    def __init__(self, spark: SparkSession, path: str, members: DataFrame | None = None):
        self.spark, self.path, self._scans = spark, path, {}
        self.book = json.loads(read_text(spark, f"{path}/{SCHEMA_FILE}"))
        self.dim = self.book["dim"]
        if members is None:
            at = shared_path(spark, "members")
            opened(spark, path, self.book).write.parquet(at)
            members = spark.read.parquet(at)
        self.members = members
        self.total, self.n_members = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.chunk = {v["name"]: tuple(v["chunk"]) for v in self.book["variables"]}
        self._schema = Schema("", [Variable(v["name"], TYPES[v["type"]], tuple(v["dims"]), (self.total, *v["shape"][1:])) for v in self.book["variables"]])

    def schema(self) -> Schema:
        return self._schema

    def attributes(self) -> dict[str | None, list[Attribute]]:
        return {name: [Attribute(a, kind, tuple(values)) for a, kind, values in own] for name, own in self.book["attributes"]}

    def stamp(self) -> object:
        return modified(self.spark, f"{self.path}/{SCHEMA_FILE}")

    def touched(self, start: int, count: int) -> DataFrame:
        """The members that a range of the joined dimension meets."""
        return self.members.where((F.col("member_start") < start + count) & (F.col("member_start") + F.col("n") > start))

    def scan(self, v: Variable) -> DataFrame:
        """All chunks of a variable; its folders are listed once."""
        if v.name not in self._scans:
            keys = "".join(f"c_{k} int, " for k in range(len(self.chunk[v.name])))
            self._scans[v.name] = self.spark.read.schema(f"{keys}payload array<{v.type.spark}>, member string").parquet(f"{self.path}/variable={v.name}")
        return self._scans[v.name]

    def rows(self, chunk_rows: DataFrame, start: int, count: int) -> DataFrame:
        """Those of a scan's rows whose members a range touches, with ``n`` and ``member_start``."""
        touched = self.touched(start, count).select(F.col("member").alias("of"), "n", "member_start")
        return chunk_rows.join(F.broadcast(touched) if self.n_members <= BROADCAST_MEMBERS else touched, F.col("member") == F.col("of"))

    def cells(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> DataFrame:
        v = self._schema.find(name)
        return taken_apart(self.rows(self.scan(v), starts[0], counts[0]), v, self.chunk[name], starts, counts, F.col("n"), F.col("member_start"))

    def runs(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> Iterator[DataFrame] | None:
        """A box that takes inner dimensions whole, some of the joined dimension at a time."""
        v = self._schema.find(name)
        if counts[1:] != v.shape[1:] or not prod(counts):
            return None
        inner = prod(v.shape[1:])
        step = max(1, chunks.RUN_CELLS // inner)
        end = starts[0] + counts[0]

        def some(low: int) -> DataFrame:
            high, chunk = min(end, low + step), self.chunk[name][0]
            first = F.col("member_start") + F.col("c_0").cast("long") * chunk
            begin = F.greatest(first, F.lit(low))
            stop = reduce(F.least, [first + chunk, F.col("member_start") + F.col("n"), F.lit(high)])
            rows = self.rows(self.scan(v), low, high - low).where(begin < stop)
            return rows.select(((begin - starts[0]) * inner).alias("place"), F.slice("payload", ((begin - first) * inner + 1).cast("int"), ((stop - begin) * inner).cast("int")).alias("values"))

        return map(some, range(starts[0], end, step))
