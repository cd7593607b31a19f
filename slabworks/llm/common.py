"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import importable

_FALLBACK: dict[str, str] = {}


_OPEN: list[list[str]] = []


@contextmanager
def cleared(spark: SparkSession):
    """Deletes what operators wrote to the shared folder within the block, which has to write its results elsewhere."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can see: ``spark.checkpoint.dir``.

    Only a session of one machine (``local[…]``) without that setting gets a temporary
    folder, one for the session, which is deleted when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="slabworks-")
        atexit.register(shutil.rmtree, _FALLBACK[app], True)
    return _FALLBACK[app]


def shared_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_root(spark)}/slabworks-{what}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def saved(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """``saved`` for tables that nothing reads any more when the block ends; they are deleted then."""
    paths = []

    def save(df: DataFrame, what: str) -> DataFrame:
        paths.append(shared_path(spark, what))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield save
    finally:
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote and no longer reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def posix(path: str) -> str:
    """A path that ``open`` and ``mmap`` take, for files that workers map."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped model files need spark.checkpoint.dir on a mounted file system, not {path}")
    return path


def write_atomic(path: str, array: np.ndarray) -> None:
    """Write ``array`` whole or not at all; a repeated or raced task rewrites the same bytes."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "wb") as f:
        np.save(f, array)
    os.replace(tmp, path)


#: Rows and bytes that go to a Python worker at once, where the session has Spark's own values.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(8 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of workers that get whole texts; a session's own settings stay.

    Results are lazy, so the settings hold for the session from here on.
    """
    importable(spark)
    for key, (default, ours) in BATCHES.items():
        if default is None or spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def fold(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def with_id(docs: DataFrame, id_col: str, rest: str, name: str = "id") -> StructType:
    """A schema of ``docs``' id, of whatever type and under ``name``, and the columns ``rest``."""
    return StructType([StructField(name, docs.schema[id_col].dataType), *StructType.fromDDL(rest).fields])


def texts(column: pa.ChunkedArray | pa.Array):
    """UTF-8 bytes of each text, null as empty, without decoding to ``str``."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return ((v.as_buffer().to_pybytes() if v.is_valid else b"") for v in column.cast(kind))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str = "group_size", parts: int = 1000) -> DataFrame:
    """Join each row with its group, where ``groups`` has ``key`` once and the group's row count.

    Fewer than ``parts`` groups can hold more than a ``1/parts`` share of all rows;
    those are broadcast, so that no task gets all rows of a large group. The others
    are joined by a shuffle.
    """
    most = F.lit((groups.agg(F.sum(size)).first()[0] or 0) / parts)
    names = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > most).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in names])
    tagged = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    of_hot = tagged.where(F.col("__hot").isNotNull()).select(*rows.columns, *[F.col(f"__{c}").alias(c) for c in names])
    others = tagged.where(F.col("__hot").isNull()).select(*rows.columns).join(groups.where(F.col(size) <= most), key).select(*rows.columns, *names)
    return of_hot.unionByName(others)


#: Bits of the table of ``maybe``: 4 MB (8 MB as Spark holds them) are broadcast at most, whatever the input.
TABLE_BITS = 1 << 25


def maybe(rows: DataFrame, key: Column, keys: DataFrame, of: Column) -> DataFrame:
    """``rows`` with ``__maybe``: false only where ``key`` is surely none of the ``of`` in ``keys``.

    The hashes of ``keys`` are marked in a table of bits of fixed size, made and read by
    Spark's bitmap functions. The more keys, the more rows pass that needn't: a join
    that follows decides, this only spares rows from being moved.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(TABLE_BITS)) + 1
    marks = keys.select(place(of).alias("__p")).groupBy(F.bitmap_bucket_number("__p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__p")).alias("__bits"))
    at = F.bitmap_bit_position("__p")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__p", place(key)).join(F.broadcast(marks), F.bitmap_bucket_number("__p") == F.col("__bucket"), "left")
    return found.select(*rows.columns, F.coalesce(F.bit_get(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("__maybe"))


def numbered(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns ``c0, c1, …``, and the columns that give it back under its own names."""
    names = docs.columns
    return docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]), [F.col(f"c{k}").alias(c) for k, c in enumerate(names)]


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with ``__key``, by which rows can be ordered: ids first by value, null ids last, ties by text."""
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    return docs.withColumn("__key", F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), sha.alias("sha")))


def keep_rows(docs: DataFrame, found: DataFrame, id_col: str, text: str, size: str = "group_size") -> DataFrame:
    """One row of ``docs`` for each distinct ``__key`` that is ``kept`` in ``found``, with all its columns.

    ``found`` has ``__key, kept`` and the rows of the key's group, each row of ``docs``
    once. A row that is alone in its group stays where it is; only rows that share one
    (and the few that the table of bits takes for such) meet the decisions in a join.
    Rows that have a key in common agree in id and text; one of them stays.
    """
    contested = found.where(F.col(size) > 1).groupBy("__key").agg(F.max("kept").alias("__kept")).withColumnRenamed("__key", "__of")
    contested = saved(contested, "contested")
    own, back = numbered(docs)  # columns may have any name
    rows = maybe(keyed(own, *(f"c{docs.columns.index(c)}" for c in (id_col, text))), F.col("__key"), contested, F.col("__of"))
    alone = rows.where(~F.col("__maybe")).select(*back)
    shared = rows.where("__maybe").dropDuplicates(["__key"])  # combined in the tasks before rows are moved
    decided = shared.join(contested.hint("merge"), F.col("__key") == F.col("__of"), "left").where(F.coalesce("__kept", F.lit(True)))
    return alone.unionByName(decided.select(*back))
