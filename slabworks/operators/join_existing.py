"""Concatenation along the outermost dimension: members ordered by their first coordinate.

On a table, members are the values of a column; their counts and ranks are an
aggregate and their offsets a running sum over one row a member.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.index import dense_index
from .slab import within


#: A table of more members than this isn't broadcast on our word; Spark chooses the join.
BROADCAST_MEMBERS = 1_000_000


def member_stats(table: DataFrame, member: Column, coordinate: Column, order: str) -> DataFrame:
    """``member, n, rank``: rows of each member, and its coordinate in the row that is first by ``order``."""
    return table.groupBy(member.alias("member")).agg(F.count(F.lit(1)).alias("n"), F.min_by(coordinate, F.col(order)).cast("double").alias("rank"))


def member_offsets(stats: DataFrame) -> DataFrame:
    """``stats`` with ``ordinal`` and ``member_start``: members by rank, then by name, and the rows before each."""
    by_rank = Window.orderBy("rank", "member")
    before = by_rank.rowsBetween(Window.unboundedPreceding, -1)
    return stats.select("*", (F.row_number().over(by_rank) - 1).alias("ordinal"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("member_start"))


def joined(table: DataFrame, member: Column, coordinate: Column, order: str, index: str = "i_joined") -> DataFrame:
    """All rows with the dense index of the whole: members by rank, rows of a member by ``order``.

    Overlaps stay; one range exchange numbers all members at once, however uneven
    they are.
    """
    members = member_offsets(member_stats(table, member, coordinate, order)).select(F.col("member").alias("__m"), "ordinal")
    return dense_index(_of_members(table, member, members), ["ordinal", order], index)


def _of_members(table: DataFrame, member: Column, members: DataFrame) -> DataFrame:
    """Rows of ``table`` whose member is in ``__m``, with ``member`` and the other columns of ``members``.

    Hot members make no hot task where ``members`` is sent to all tasks, as Spark
    does below its own limit; beyond it adaptive execution splits them.
    """
    return table.withColumn("member", member).join(members, F.col("member").eqNullSafe(F.col("__m"))).drop("__m")


def joined_range(table: DataFrame, member: Column, coordinate: Column, order: str, start: int, count: int, index: str = "i_joined") -> DataFrame:
    """``joined``, cut to ``count`` rows from ``start`` on; only members that the range touches are numbered.

    Where ``member`` is a partition column, members that aren't touched aren't read: the
    few that are reach the scan by dynamic partition pruning. The plan is the same for
    any number of members; the driver gets two numbers.
    """
    members = member_offsets(member_stats(table, member, coordinate, order))
    touched = members.where((F.col("member_start") < start + count) & (F.col("member_start") + F.col("n") > start) & F.lit(count > 0))
    touched = touched.select(F.col("member").alias("__m"), "ordinal", "member_start")
    first, n = touched.agg(F.min("member_start"), F.count(F.lit(1))).first()
    names = touched.drop("member_start")
    rows = _of_members(table, member, F.broadcast(names) if n <= BROADCAST_MEMBERS else names)
    numbered = dense_index(rows, ["ordinal", order], index).withColumn(index, F.col(index) + (first or 0))
    return numbered.where(within(F.col(index), start, count))


def first_member(table: DataFrame, member: Column, coordinate: Column, order: str) -> DataFrame:
    """The rows of the member that comes first, and no others: what variables without the joined dimension are read from."""
    name = member_offsets(member_stats(table, member, coordinate, order)).where("ordinal = 0").select("member").first()
    rows = table.withColumn("member", member)
    return rows.limit(0) if name is None else rows.where(F.col("member").eqNullSafe(F.lit(name[0])))


@dataclass(frozen=True)
class Piece:
    """What one member gives to a range: its ordinal, the first index inside it, the count, and its offset."""

    ordinal: int
    start: int
    count: int
    offset: int


def pieces(sizes: list[int], start: int, count: int) -> list[Piece]:
    """The members that a range of the whole touches, each with its own part of the range."""
    out, offset = [], 0
    for k, n in enumerate(sizes):
        low, high = max(start, offset), min(start + count, offset + n)
        if low < high:
            out.append(Piece(k, low - offset, high - low, offset))
        offset += n
    return out
