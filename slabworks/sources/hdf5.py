"""HDF5 and NetCDF-4 files.

The file is described on the driver; cells are read by Spark's Python data source, a
partition for each run of the outermost dimension, so executors read only the slab
they are asked for.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.attributes import HIDDEN, Attribute
from ..plans.schema import Schema, Variable, type_of_numpy
from ..session import importable
from .base import ArraySource
from .hdf5_format import File, Kind, Object

PARTITION_CELLS = 4_000_000
RAW_BYTES = 1 << 20


def element_type(kind: Kind):
    return type_of_numpy(kind.dtype.str[1:]) if kind.what == "number" and kind.dtype.str[1:] != "i1" else None


def dimensions(names: dict[int, str], name: str, data: Object) -> tuple[str, ...]:
    """Names of the attached dimension scales; without them the variable's own name, once."""
    listed = data.attributes.get("DIMENSION_LIST")
    if not listed or not all(refs and refs[0] in names for refs in listed):
        return () if data.shape == () else (name,)
    return tuple(names[refs[0]] for refs in listed)


def attribute(name: str, value) -> Attribute:
    """Fixed-length text, 16- and 32-bit integers and floats are served, alone or in a list; nothing else is."""
    if isinstance(value, bytes):
        return Attribute(name, "String", (value.decode("ascii", "replace"),))
    if not isinstance(value, np.ndarray):
        return Attribute(name, "unsupported", ())
    kind = {"i2": "Int16", "i4": "Int32", "f4": "Float32", "f8": "Float64"}.get(value.dtype.str[1:], "unsupported")
    return Attribute(name, kind, tuple(value.reshape(-1).tolist()))


class Hdf5Source(ArraySource):
    """The root group's datasets of a file; those without storage are skipped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._variables, self._attributes = [], {}
        with File(path) as f:
            names = {at: name for name, at in f.root.links.items()}
            self._attributes[None] = [attribute(k, v) for k, v in f.root.attributes.items() if k not in HIDDEN]
            for name, at in f.root.links.items():
                data = f.object(at)
                if not data.is_dataset or data.shape is None or not data.stored:
                    continue
                self._variables.append(Variable(name, element_type(data.kind), dimensions(names, name, data), tuple(data.shape)))
                self._attributes[name] = [attribute(k, v) for k, v in data.attributes.items() if k not in HIDDEN]

    def schema(self) -> Schema:
        return Schema("", self._variables)

    def listed(self) -> list[str]:
        return [v.name for v in self._variables]

    def attributes(self) -> dict[str | None, list[Attribute]]:
        return self._attributes

    def stamp(self) -> object:
        return os.stat(self.path).st_mtime_ns

    def cells(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> DataFrame:
        v = self.schema().find(name)
        importable(self.spark).dataSource.register(SlabDataSource)
        columns = ", ".join([*(f"`i_{a}` int" for a in v.axes), f"value {v.type.spark}"])
        box = {"starts": ",".join(map(str, starts)), "counts": ",".join(map(str, counts))}
        return self.spark.read.format("array_slab").schema(columns).options(path=self.path, variable=name, **box).load()

    def raw(self) -> Iterator[bytes]:
        with open(self.path, "rb") as f:
            while piece := f.read(RAW_BYTES):
                yield piece


class Run(InputPartition):
    def __init__(self, start: int, count: int):
        super().__init__(None)
        self.start, self.count = start, count


class SlabDataSource(DataSource):
    """Options: ``path``, ``variable``, ``starts``, ``counts`` (numbers with commas between)."""

    @classmethod
    def name(cls) -> str:
        return "array_slab"

    def schema(self) -> str:
        raise ValueError("give the schema of the cells")

    def reader(self, schema) -> DataSourceReader:
        return SlabReader(self.options, schema)


class SlabReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.variable = options["path"], options["variable"]
        self.starts, self.counts = ([int(x) for x in options[k].split(",") if x] for k in ("starts", "counts"))
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        if not self.counts:
            return [Run(0, 1)]
        step = max(1, PARTITION_CELLS // max(1, int(np.prod(self.counts[1:]))))
        end = self.starts[0] + self.counts[0]
        return [Run(at, min(step, end - at)) for at in range(self.starts[0], end, step)] or [Run(self.starts[0], 0)]

    def read(self, partition: Run):
        import pyarrow as pa

        starts = [partition.start, *self.starts[1:]] if self.counts else []
        counts = [partition.count, *self.counts[1:]] if self.counts else []
        with File(self.path) as f:
            values = f.object(f.root.links[self.variable]).read(starts, counts)
        index = np.indices(values.shape, dtype=np.int32).reshape(len(counts), values.size)
        flat = values.reshape(-1).astype(values.dtype.newbyteorder("="))
        from pyspark.sql.pandas.types import to_arrow_type

        columns = [pa.array(index[k] + np.int32(starts[k]), pa.int32()) for k in range(len(counts))]
        columns.append(pa.array(flat).cast(to_arrow_type(self.schema["value"].dataType)))
        yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)
