"""Tables as array datasets: each row is a place along one dense dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import Attribute
from ..operators.slab import index_type, within
from ..plans.schema import Schema, Variable, type_of_spark
from .base import ArraySource


class NotDense(ValueError):
    """The index column doesn't count the rows from 0."""


def dense_length(table: DataFrame, index: str) -> int:
    """The number of rows, if ``index`` has each number below it; told by its count, range, sum and sum of squares."""
    i = F.col(index).cast("decimal(38,0)")
    rows, n, low, high, total, squares = table.agg(F.count(F.lit(1)), F.count(index), F.min(index), F.max(index), F.sum(i), F.sum(F.col(index).cast("decimal(19,0)") * F.col(index).cast("decimal(19,0)"))).first()
    if rows == 0:
        return 0
    if n != rows or low != 0 or high != n - 1 or total != n * (n - 1) // 2 or squares != (n - 1) * n * (2 * n - 1) // 6:
        raise NotDense(f"{index} doesn't count the {rows} rows from 0")
    return n


class TableSource(ArraySource):
    """Columns of numbers are variables along ``dim``; columns of number lists are variables along ``dim`` and their own inner dimension.

    ``index`` is an integer column that counts the rows from 0 without gap or repeat, which
    is checked by one aggregate at opening unless ``length`` is given. ``inner`` names the inner
    dimension of list columns and its length. The dimensions themselves are variables
    too: ``dim`` has the values of the column ``coordinate`` (or else the index), and
    inner dimensions count from 0. Other
    columns (strings, times) are listed in attribute text but not served.
    """

    def __init__(self, table: DataFrame, dim: str, index: str, inner: dict[str, tuple[str, int]] | None = None, coordinate: str | None = None, length: int | None = None, attributes: dict[str | None, list[Attribute]] | None = None):
        self.table, self.dim, self.index, self.inner = table, dim, index, inner or {}
        self.coordinate = coordinate or index
        self.length = dense_length(table, index) if length is None else length
        self._attributes = {None: []} | (attributes or {})
        kinds = dict(table.dtypes)
        self.variables = [Variable(dim, type_of_spark(kinds[self.coordinate]), (dim,), (self.length,))]
        for d, n in dict(self.inner.values()).items():
            self.variables.append(Variable(d, type_of_spark("int"), (d,), (n,)))
        for c, kind in table.dtypes:
            if c in self.inner:
                d, n = self.inner[c]
                self.variables.append(Variable(c, type_of_spark(kind.removeprefix("array<").removesuffix(">")), (dim, d), (self.length, n)))
            elif c not in (index, self.coordinate):
                self.variables.append(Variable(c, type_of_spark(kind), (dim,), (self.length,)))

    def schema(self) -> Schema:
        return Schema("", self.variables)

    def listed(self) -> list[str]:
        return [v.name for v in self.variables]

    def attributes(self) -> dict[str | None, list[Attribute]]:
        return self._attributes

    def cells(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> DataFrame:
        spark = self.table.sparkSession
        if name in dict(self.inner.values()):
            n = starts[0] + counts[0]
            return spark.range(starts[0], n).select(F.col("id").cast("int").alias(f"i_{name}"), F.col("id").cast("int").alias("value"))
        place = within(F.col(self.index), starts[0], counts[0], self.length)
        rows = self.table if place is None else self.table.where(place)
        at = F.col(self.index).cast(index_type(self.length)).alias(f"i_{self.dim}")
        if name in self.inner:
            d, n = self.inner[name]
            values = F.col(name) if (starts[1], counts[1]) == (0, n) else F.slice(name, starts[1] + 1, counts[1])
            return rows.select(at, F.posexplode(values).alias("k", "value")).select(f"i_{self.dim}", (F.col("k") + starts[1]).cast("int").alias(f"i_{d}"), "value")
        return rows.select(at, F.col(self.coordinate if name == self.dim else name).alias("value"))
