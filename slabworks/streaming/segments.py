"""Data responses written by tasks: files of encoded cells and a manifest that puts them in order.

Each task of the sorted cells writes one segment; the driver gets a line for each
segment. A response is there when its manifest is: a failed job removes its segments
and leaves no manifest. Segments are written and read as files, so the folder has to
be on a mounted file system that executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.wire import SEPARATOR, length_header
from ..plans.schema import Leaf
from ..session import importable, posix
from ..sources.base import Dataset
from .body import encoded_rows

MANIFEST = "manifest.json"
PIECE = 1 << 20


@dataclass
class Segment(WriterCommitMessage):
    name: str
    first: int
    bytes: int


class SegmentDataSource(DataSource):
    """Options: ``path``, ``wire`` (bytes of a cell), ``cells``. Columns: ``first, payload``, in order within a task."""

    @classmethod
    def name(cls) -> str:
        return "array_segments"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SegmentWriter(posix(self.options["path"]), int(self.options["wire"]), int(self.options["cells"]))


class SegmentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, wire: int, cells: int):
        self.path, self.wire, self.cells, self.run = path, wire, cells, uuid.uuid4().hex
        os.makedirs(path, exist_ok=True)

    def write(self, iterator) -> Segment:
        """A task's run of cells. Another attempt writes another file; only one of them is told of."""
        name, first, size = f"{self.run}-{uuid.uuid4().hex}", None, 0
        with open(os.path.join(self.path, f"{name}.tmp"), "wb") as f:
            for batch in iterator:
                for at, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if first is None:
                        first = at
                    if at * self.wire != first * self.wire + size:
                        raise ValueError(f"cell {at} doesn't follow {size} bytes from cell {first}")
                    size += f.write(payload.as_buffer())
        if first is None:
            os.remove(os.path.join(self.path, f"{name}.tmp"))
            return Segment("", 0, 0)
        os.replace(os.path.join(self.path, f"{name}.tmp"), os.path.join(self.path, name))
        return Segment(name, first, size)

    def commit(self, messages) -> None:
        """The manifest, if segments follow each other without a gap; other files of the run go."""
        parts = sorted((m for m in messages if m and m.name), key=lambda m: m.first)
        at = 0
        for m in parts:
            if m.first * self.wire != at:
                raise ValueError(f"segments end at byte {at}, the next begins at {m.first * self.wire}")
            at += m.bytes
        if at != self.cells * self.wire:
            raise ValueError(f"{at} bytes of {self.cells * self.wire}")
        self._clear({m.name for m in parts})
        put(os.path.join(self.path, MANIFEST), {"bytes": at, "segments": [[m.name, m.first * self.wire, m.bytes] for m in parts]})

    def abort(self, messages) -> None:
        self._clear(set())

    def _clear(self, kept: set[str]) -> None:
        for name in os.listdir(self.path):
            if name.startswith(self.run) and name not in kept:
                os.remove(os.path.join(self.path, name))


def put(path: str, value: object) -> None:
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "w") as f:
        json.dump(value, f)
    os.replace(tmp, path)


def place(leaf: Leaf, axes: list[str]) -> Column:
    """A cell's place in the row-major order of its box."""
    out = F.lit(0).cast("long")
    for axis, start, count, step in zip(axes, leaf.starts, leaf.counts, leaf.steps or (1,) * len(axes), strict=True):
        at = F.col(axis) - start
        out = out * count + (at if step == 1 else F.floor(at / step))
    return out


def write_leaf(cells: DataFrame, leaf: Leaf, axes: list[str], path: str) -> None:
    importable(cells.sparkSession).dataSource.register(SegmentDataSource)
    rows = encoded_rows(cells, axes, leaf.type, place(leaf, axes))
    rows.write.format("array_segments").options(wire=leaf.type.wire, cells=leaf.cells).mode("append").save(path)


def write_dods(dataset: Dataset, query: str | None, path: str) -> int:
    """Write a data response below ``path``; its length. Its manifest is written last."""
    answer, parts = dataset.bind(query), [["text", (str(dataset.bind(query)).encode() + SEPARATOR).hex()]]
    for k, leaf in enumerate(answer.leaves):
        if not leaf.scalar:
            parts.append(["text", length_header(leaf.cells).hex()])
        write_leaf(dataset.leaf(leaf), leaf, [f"i_{a}" for a in dataset.schema.find(leaf.name).axes], f"{path}/{k}")
        parts.append(["leaf", str(k)])
    dataset.check()  # a source that changed meanwhile has no answer
    put(os.path.join(posix(path), MANIFEST), {"bytes": answer.content_length, "parts": parts})
    return answer.content_length


def pieces_of(path: str) -> Iterator[tuple[int, object]]:
    """``bytes, source`` of a response in order: bytes, or the path of a segment."""
    with open(os.path.join(path, MANIFEST)) as f:
        for kind, what in json.load(f)["parts"]:
            if kind == "text":
                yield len(what) // 2, bytes.fromhex(what)
                continue
            with open(os.path.join(path, what, MANIFEST)) as g:
                for name, _, size in json.load(g)["segments"]:
                    yield size, os.path.join(path, what, name)


def read_dods(path: str, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
    """Bytes ``start`` to ``stop`` of a written response, a piece at a time; segments outside aren't opened."""
    path, at = posix(path), 0
    for size, source in pieces_of(path):
        low, high = max(start, at) - at, (size if stop is None else min(stop, at + size) - at)
        at += size
        if low >= high:
            continue
        if isinstance(source, bytes):
            yield source[low:high]
            continue
        with open(source, "rb") as f:
            f.seek(low)
            while low < high and (piece := f.read(min(PIECE, high - low))):
                low += len(piece)
                yield piece


def stored_payload(spark: SparkSession, path: str, leaf: int) -> DataFrame:
    """``first, payload`` of a written array's segments, read by tasks; ``first`` counts bytes of the array."""
    with open(os.path.join(posix(path), str(leaf), MANIFEST)) as f:
        known = json.load(f)["segments"]
    names = spark.createDataFrame([(name, first) for name, first, _ in known], "name string, first long")
    files = spark.read.format("binaryFile").load([f"{path}/{leaf}/{name}" for name, *_ in known])
    return files.withColumn("name", F.substring_index("path", "/", -1)).join(F.broadcast(names), "name").select("first", F.col("content").alias("payload"))
