"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of slots; each shard owns the arcs that end at its virtual
nodes. A row's hash gives its slot and so its arc. A shard takes rows only up to its
capacity; what overflows goes on clockwise to the next arc whose shard has room.
Capacities are the row count shared out exactly, so shards differ by at most one row.

Rows never visit the driver. It sees the number of rows of each arc, a list whose
length is fixed by the ring, works out which ranks of each arc overflow where, and
gives the ranges back as a table of bounded size that is joined with the ranked rows.
Ranks are counted in ``PARTS`` parts of each arc, told apart by a hash of the whole row,
so that the rows of one id, however many, are ranked by as many tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, saved

VIRTUAL_NODES = 64
SLOTS = 1 << 16
PARTS = 64


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES, slots: int = SLOTS) -> DataFrame:
    """``arc, shard, last``: the virtual nodes clockwise, and the slot where the arc of each ends.

    Of nodes on one slot the smallest shard's stands.
    """
    nodes = (
        spark.range(shards * virtual_nodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
        .select(F.pmod(F.xxhash64(F.lit("shard"), "shard", "replica"), F.lit(slots)).alias("last"), "shard")
        .groupBy("last")
        .agg(F.min("shard").alias("shard"))
    )
    return nodes.select((F.row_number().over(Window.orderBy("last")) - 1).alias("arc"), "shard", "last")


def slot_table(nodes: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``__slot, __arc`` of every slot of the ring; past the last node it goes on at the first."""
    clockwise = Window.orderBy("last")
    first = F.coalesce(F.lag("last").over(clockwise) + 1, F.lit(0).cast("long"))
    own = nodes.withColumn("first", first).select(F.col("arc").alias("__arc"), F.explode(F.sequence("first", "last")).alias("__slot"))
    rest = nodes.agg(F.max("last").alias("m")).where(F.col("m") < slots - 1).select(F.lit(0).alias("__arc"), F.explode(F.sequence(F.col("m") + 1, F.lit(slots - 1).cast("long"))).alias("__slot"))
    return own.unionByName(rest)


def flow(counts: list[int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Who takes what: ``(arc, first rank, last rank + 1, shard, first slot in the shard)``.

    ``counts`` are the rows of each arc, ``owner`` its shard, ``room`` the capacity of
    each shard. All arcs first fill their own shards, clockwise; what is left of each
    moves on by one arc at a time.
    """
    arcs, room, taken = len(counts), list(room), [0] * len(room)
    done = [0] * arcs
    out = []
    left = [a for a in range(arcs) if counts[a]]
    for step in range(arcs):
        for a in left:
            shard = owner[(a + step) % arcs]
            n = min(counts[a] - done[a], room[shard] - taken[shard])
            if n > 0:
                out.append((a, done[a], done[a] + n, shard, taken[shard]))
                done[a] += n
                taken[shard] += n
        left = [a for a in left if done[a] < counts[a]]
        if not left:
            break
    return out


def shares(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", virtual_nodes: int = VIRTUAL_NODES, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in each shard).

    Counts differ by at most one. A row's place on the ring is the hash of its id; a
    null id's is the hash of the other columns, ids may repeat, and rows that agree in every
    column may take each other's places. Columns of the same names are replaced; others may
    have any name. No rows give no rows.
    """
    spark = docs.sparkSession
    nodes = ring(spark, shards, virtual_nodes, slots)
    owner = [r["shard"] for r in nodes.orderBy("arc").collect()]
    if missing := set(range(shards)) - set(owner):
        raise ValueError(f"no virtual node is left of shards {sorted(missing)}: raise virtual_nodes or slots")
    rows, back = numbered(docs.drop("shard", "slot"))  # columns may have any name
    whole = [c for c in docs.columns if c not in ("shard", "slot")]
    own = F.col(f"c{whole.index(id_col)}")
    rest = [F.col(f"c{k}") for k, c in enumerate(whole) if c != id_col and docs.schema[c].dataType.typeName() not in ("map", "variant")]
    place = F.when(own.isNull(), F.xxhash64(F.lit("null"), *rest)).otherwise(F.xxhash64(F.lit("row"), own))
    rows = rows.withColumn("__hash", place).withColumn("__slot", F.pmod("__hash", F.lit(slots))).withColumn("__part", F.pmod(F.xxhash64(F.lit("part"), own, *rest), F.lit(PARTS)))
    rows = rows.join(F.broadcast(slot_table(nodes, slots)), "__slot")  # ``slots`` rows, whatever the input
    sizes = saved(rows.groupBy("__arc", "__part").agg(F.count(F.lit(1)).alias("__n")), "arcs")  # ``PARTS`` rows for each arc at most
    counts = [0] * len(owner)
    for r in sizes.groupBy("__arc").agg(F.sum("__n").alias("n")).collect():  # a row for each arc
        counts[r["__arc"]] = r["n"]
    before = Window.partitionBy("__arc").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__arc", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    plan = flow(counts, owner, shares(sum(counts), shards))
    kind = "array<struct<__of:int,__first:bigint,__last:bigint,shard:int,__at:bigint>>"
    names = ("__of", "__first", "__last", "shard", "__at")
    listed = F.from_json(F.lit(json.dumps([dict(zip(names, p, strict=True)) for p in plan])), kind)
    table = spark.range(1).select(F.inline(listed))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__arc", "__part").orderBy("__hash", own, *rest)) - 1)
    # the rows lie by arc and part already, so only the starts are moved to them
    ranked = ranked.join(starts.hint("merge"), ["__arc", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    placed = ranked.join(F.broadcast(table), (F.col("__arc") == F.col("__of")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__last")))
    return placed.select(*back, "shard", (F.col("__at") + F.col("__rank") - F.col("__first")).alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shard_rows(docs, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
