"""A member table that follows its store: members that are added are counted once, by a stream of the coordinate's new files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import read_text
from ..sources.chunks import SCHEMA_FILE
from ..sources.members import coordinate_schema, merged, partial_stats


def follow(spark: SparkSession, store: str, table: str, checkpoint: str, once: bool = True, files: int = 1000) -> StreamingQuery:
    """Start to keep ``table``, the counts of the members of a store; with ``once`` it ends when what is there has been counted.

    The checkpoint knows which files have been counted. A batch's counts are a folder of
    their own, which a batch that runs again after a failure replaces, so no file counts
    twice; a member whose files come in several batches has a row in each. At most
    ``files`` files are a batch, so a batch's work is bounded however many members are new.
    """
    book = json.loads(read_text(spark, f"{store}/{SCHEMA_FILE}"))
    chunks = spark.readStream.schema(coordinate_schema(book)).option("maxFilesPerTrigger", files).parquet(f"{store}/variable={book['dim']}")

    def count(rows: DataFrame, batch: int) -> None:
        partial_stats(rows).write.mode("overwrite").parquet(f"{table}/batch={batch}")

    stream = chunks.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start() if once else stream.start()


def followed(spark: SparkSession, table: str) -> DataFrame:
    """``member, n, rank, ordinal, member_start``, as ``members.opened`` gives them, of what has been counted."""
    return merged(spark.read.schema("member string, n long, head struct<c_0:int,rank:double>").parquet(table))
