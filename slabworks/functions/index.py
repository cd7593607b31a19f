"""A dense index over the rows of a table in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path


def file_order(path: Column) -> Column:
    """The place of a written file among its table's: its task's number, then its own within the task."""
    number = lambda pattern: F.coalesce(F.regexp_extract(path, pattern, 1).cast("long"), F.lit(0))
    return F.struct(number(r"/part-(\d+)[^/]*$").alias("task"), number(r"-c(\d+)[^/]*$").alias("file"))


def dense_index(df: DataFrame, order: list[str], name: str = "i", path: str | None = None) -> DataFrame:
    """``df`` with ``name`` counting its rows from 0 in the order of columns that no two rows share.

    Rows are dealt out by range, sorted, and written to ``path``: the ranges are decided
    once, and what the result reads are files, so tasks that a lost executor takes with it
    are run again over the same rows. A row's index is its place in its file plus the rows
    of the files before, a sum over one row a file; no task sees all rows and nothing is
    kept in executors. ``path`` is a folder that the caller owns; without one it is a
    new folder below ``spark.checkpoint.dir``, which stays there for the lazy result.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, "index")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return stored_index(spark.read.schema(df.schema).parquet(path), name)


def stored_index(stored: DataFrame, name: str = "i") -> DataFrame:
    """The index of a Parquet table whose files hold runs of the order, one after the other."""
    rows = stored.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__k"))
    counts = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n")).withColumn("__at", file_order(F.col("__file")))
    before = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__file").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    return rows.join(F.broadcast(offsets), F.col("__file") == F.col("__of")).select(*stored.columns, (F.col("__from") + F.col("__k")).alias(name))  # a row for each file
