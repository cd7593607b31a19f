"""Chunk stores as a Spark data source: ``spark.read.format("array_cells").load(path).where("i_lat BETWEEN 3 AND 9")``.

Comparisons of indices with numbers become a box before partitions are made, so only
files and row groups with chunks of the box are read, by tasks. Python workers read the
files themselves: the store has to be on a mounted file system. Without pushdown
(``spark.sql.python.filterPushdown.enabled``, which ``register`` sets) the whole array is read and Spark filters.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.slab import index_type
from ..plans.schema import TYPES, Variable
from ..session import importable, posix
from .chunks import SCHEMA_FILE

#: Row groups' files that a task reads.
FILES = 8


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    importable(spark).dataSource.register(CellsDataSource)


class CellsDataSource(DataSource):
    """Options: ``path`` of a chunk store, ``variable`` (its only one if left out). Columns: ``i_<axis>…, value``."""

    def __init__(self, options):
        super().__init__(options)
        path = posix(options["path"])
        with open(os.path.join(path, SCHEMA_FILE)) as f:
            book = {v["name"]: v for v in json.load(f)["variables"]}
        name = options.get("variable") or (next(iter(book)) if len(book) == 1 else None)
        if name not in book:
            raise ValueError(f"variable must be one of {', '.join(book)}")
        v = book[name]
        self.path, self.chunk = os.path.join(path, f"variable={name}"), tuple(v["chunk"])
        self.variable = Variable(name, TYPES[v["type"]], tuple(v["dims"]), tuple(v["shape"]))

    @classmethod
    def name(cls) -> str:
        return "array_cells"

    def schema(self) -> str:
        v = self.variable
        return ", ".join([*(f"`i_{a}` {index_type(n)}" for a, n in zip(v.axes, v.shape, strict=True)), f"value {v.type.spark}"])

    def reader(self, schema) -> DataSourceReader:
        return CellsReader(self.path, self.variable, self.chunk, schema)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class CellsReader(DataSourceReader):
    def __init__(self, path: str, variable: Variable, chunk: tuple[int, ...], schema):
        self.path, self.variable, self.chunk, self.out = path, variable, chunk, schema
        self.low, self.high = [0] * len(chunk), [n - 1 for n in variable.shape]  # both ends included

    def pushFilters(self, filters) -> Iterator:
        """Comparisons of an index narrow the box; what a box can't say is left to Spark."""
        axes = {f"i_{a}": k for k, a in enumerate(self.variable.axes)}
        for f in filters:
            k = axes.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if k is None or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
                yield f
                continue
            v = f.value
            if isinstance(f, In):  # its ends narrow the box; Spark still looks at each cell
                known = [x for x in v if x is not None]
                low, high = (min(known), max(known)) if known else (0, -1)
                yield f
            else:
                low = v + 1 if isinstance(f, GreaterThan) else v if isinstance(f, (EqualTo, GreaterThanOrEqual)) else 0
                high = v - 1 if isinstance(f, LessThan) else v if isinstance(f, (EqualTo, LessThanOrEqual)) else self.high[k]
            self.low[k], self.high[k] = max(self.low[k], low), min(self.high[k], high)

    def wanted(self) -> list[tuple[str, str, int]]:
        """The chunks that the box meets, as comparisons of the files' columns."""
        return [x for k, n in enumerate(self.chunk) for x in ((f"c_{k}", ">=", self.low[k] // n), (f"c_{k}", "<=", self.high[k] // n))]

    def partitions(self) -> list[InputPartition]:
        """Some files each; statistics in the files tell a task which of their row groups it needs."""
        if any(a > b for a, b in zip(self.low, self.high, strict=True)):
            return [Files([])]
        paths = sorted(glob.glob(f"{glob.escape(self.path)}/*.parquet"))
        return [Files(paths[k : k + FILES]) for k in range(0, len(paths), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        v, axes = self.variable, range(len(self.chunk))
        kinds = [to_arrow_type(f.dataType) for f in self.out.fields]
        for path in partition.paths:
            table = pq.read_table(path, columns=[*(f"c_{k}" for k in axes), "payload"], filters=self.wanted() or None)
            for row in zip(*(table.column(f"c_{k}").to_pylist() for k in axes), table.column("payload"), strict=True):
                *at, payload = row
                first = [c * n for c, n in zip(at, self.chunk, strict=True)]
                extent = [min(n, size - f) for f, n, size in zip(first, self.chunk, v.shape, strict=True)]
                cut = [slice(max(0, lo - f), min(e, hi - f + 1)) for f, e, lo, hi in zip(first, extent, self.low, self.high, strict=True)]
                places = np.arange(prod(extent)).reshape(extent)[tuple(cut)]
                index = np.indices(places.shape, dtype=np.int64).reshape(len(at), places.size)
                columns = [pa.array(index[k] + first[k] + cut[k].start).cast(kinds[k]) for k in axes]
                columns.append(payload.values.take(pa.array(places.reshape(-1))).cast(kinds[-1]))
                yield pa.RecordBatch.from_arrays(columns, names=self.out.names)
