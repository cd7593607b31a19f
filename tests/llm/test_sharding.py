import re
import zlib
from collections import defaultdict

from tables import SF, edges, rows

from slabworks.llm import sharding as m


def check(found, shards):
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return {r["doc_id"]: r["shard"] for r in found}


def test_query(spark):
    found = m.op10_sharding(spark, SF).collect()
    check(found, 24)
    texts = dict(rows())
    for r in found:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert len(found) == len(texts)


def test_no_python_on_the_executors(spark):
    plan = m.op10_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_rows_go_where_a_row_by_row_walk_puts_as_many(spark):
    """Every arc keeps what its shard has room for, and only what overflows moves on."""
    counts, owner, room = [5, 0, 7, 2, 1], [0, 1, 0, 2, 1], [5, 5, 5]
    plan = m.flow(counts, owner, room)
    own = {a: sum(hi - lo for b, lo, hi, s, _ in plan if b == a and s == owner[a]) for a in range(5)}
    assert own == {0: 5, 1: 0, 2: 0, 3: 2, 4: 1}
    assert [(lo, hi, s) for a, lo, hi, s, _ in plan if a == 2] == [(0, 3, 2), (3, 7, 1)]
    assert sum(hi - lo for _, lo, hi, _, _ in plan) == 15


def test_few_rows_move_when_a_shard_is_added(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a, b = check(m.shard_rows(docs, 24).collect(), 24), check(m.shard_rows(docs, 25).collect(), 25)
    assert sum(a[i] != b[i] for i in a) / len(a) < 0.2
    again = check(m.shard_rows(docs.repartition(7), 24).collect(), 24)
    assert again == a


def test_slots_of_the_ring(spark):
    nodes = m.ring(spark, 5, 8, 256)
    of = {r["__slot"]: r["__arc"] for r in m.slot_table(nodes, 256).collect()}
    ends = sorted((r["last"], r["arc"]) for r in nodes.collect())
    assert sorted(of) == list(range(256)) and all(of[s] == next((a for e, a in ends if e >= s), 0) for s in of)


def test_edges(spark):
    df = edges(spark)
    found = m.shard_rows(df, 4)
    assert found.columns == [*df.columns, "shard", "slot"]
    check(found.collect(), 4)
    check(m.shard_rows(found, 3).collect(), 3)
    assert m.shard_rows(df.limit(0), 4).count() == 0
    check(m.shard_rows(df.limit(1), 4).collect(), 4)
    check(m.shard_rows(df, 1).collect(), 1)


def walked(rows, shards):
    """Shard of each row by a walk of the ring row by row: own shards first, then clockwise step by step.

    ``rows`` are in the order of their arcs' ranks, with their arcs; ``shards`` own the arcs.
    """
    owner, total = shards
    n = max(owner) + 1
    room = [total // n + (s < total % n) for s in range(n)]
    of, waiting = {}, list(rows)
    for step in range(len(owner)):
        left = []
        for row, arc in waiting:
            shard = owner[(arc + step) % len(owner)]
            if room[shard]:
                room[shard] -= 1
                of[row] = shard
            else:
                left.append((row, arc))
        waiting = left
    return of


def test_every_row_is_where_a_walk_row_by_row_puts_it(spark):
    """Hashes by Spark; slots, arcs, ranks and the walk by hand, a third of the rows with one id."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k if k % 3 else 7, k) for k in range(1200)], "doc_id long, n long")
    shards, virtual, slots = 5, 8, 256
    nodes = [(r["s"], r["h"] % slots) for r in spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("s"), F.floor(F.col("id") / shards).alias("r")).select("s", F.xxhash64(F.lit("shard"), "s", "r").alias("h")).collect()]
    ends = {}
    for s, at in nodes:
        ends[at] = min(s, ends.get(at, s))
    lasts = sorted(ends)
    owner = [ends[x] for x in lasts]
    hashed = docs.select("n", F.xxhash64(F.lit("row"), "doc_id").alias("h"), "doc_id", F.xxhash64(F.lit("part"), "doc_id", "n").alias("p")).collect()
    rows = []
    for r in hashed:
        slot = r["h"] % slots
        arc = next((a for a, x in enumerate(lasts) if x >= slot), 0)
        rows.append(((arc, r["p"] % m.PARTS, r["h"], r["doc_id"], r["n"]), arc))
    rows.sort()
    want = {row[-1]: s for row, s in walked(rows, (owner, len(rows))).items()}
    found = m.shard_rows(docs, shards, virtual_nodes=virtual, slots=slots).collect()
    assert {r["n"]: r["shard"] for r in found} == want
    check(found, shards)
