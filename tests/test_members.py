"""Joined members as partitions, opened by jobs; numbering that survives lost executors."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabworks.functions.attributes import Attribute
from slabworks.functions.index import dense_index, stored_index
from slabworks.operators.join_existing import joined_range
from slabworks.sources import aggregate, chunks
from slabworks.sources.aggregate import JoinedSource
from slabworks.sources.base import Dataset, Together
from slabworks.sources.chunks import ChunkStore, open_stores, write_store
from slabworks.sources.members import MemberStore, write_members
from slabworks.sources.tables import TableSource

N = 1000


@pytest.fixture(scope="module", autouse=True)
def listed_by_the_driver(spark):
    """A job for each listing is slow in tests."""
    key = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    spark.conf.set(key, "5000")
    yield
    spark.conf.unset(key)


def leaves(plan):
    """The nodes of an executed plan that have no child, through adaptive stages."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return leaves(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return leaves(plan.plan())
    found = plan.children()
    return [x for k in range(found.size()) for x in leaves(found.apply(k))] or [plan]


def files_read(df, of):
    """Files that the scan of a path read, after the result was collected."""
    scans = [x for x in leaves(df._jdf.queryExecution().executedPlan()) if "FileSourceScan" in x.getClass().getSimpleName() and of in x.toString()]
    assert len(scans) == 1
    return scans[0].metrics().apply("numFiles").value()


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """1,000 members of 1 to 5 rows whose names don't sort as their coordinates."""
    path = str(tmp_path_factory.mktemp("many") / "store")
    rows = spark.range(N).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(0), (F.col("id") % 5).cast("int"))).alias("k"))
    rows = rows.select(((F.col("m") * 77) % N).alias("name"), F.col("k"), (F.col("m") * 10 + F.col("k")).cast("int").alias("t"), (F.col("m") * 0.5 + F.col("k")).alias("v"))
    write_members(path, rows, F.col("name"), "k", "t", F.col("t"), ["v"], attributes={None: [Attribute("title", "String", ("many",))]})
    values = [m * 0.5 + k for m in range(N) for k in range(m % 5 + 1)]
    return path, values


def test_a_range_of_a_thousand_members_reads_the_members_it_meets(spark, many):
    path, values = many
    source = MemberStore(spark, path)
    assert source.n_members == N and source.total == len(values) == 3000
    start = values.index(500.5)  # the second member's first row is the fourth of the range
    lengths = [m % 5 + 1 for m in range(N)]
    m = next(m for m in range(N) if sum(lengths[:m]) <= start < sum(lengths[: m + 1]))
    low = sum(lengths[:m]) + 1 if lengths[m] > 1 else sum(lengths[:m])
    count = sum(lengths[: m + 1]) - low + 1
    found = source.cells("v", (low,), (count,))
    assert [r["value"] for r in sorted(found.collect(), key=lambda r: r["i_t"])] == values[low : low + count]
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruningexpression(member" in plan and files_read(found, "variable=v") == 2
    whole = source.cells("v", (0,), (3000,))
    assert [r["value"] for r in sorted(whole.collect(), key=lambda r: r["i_t"])] == values and files_read(whole, "variable=v") == N
    sizes = [len(x._jdf.queryExecution().optimizedPlan().toString()) for x in (found, source.cells("v", (1,), (2998,)))]
    assert abs(sizes[0] - sizes[1]) < 500 and max(sizes) < 20_000


def test_texts_and_bytes_of_a_member_store(spark, many, monkeypatch):
    path, values = many
    d = Dataset("many", MemberStore(spark, path))
    assert "Float64 v[t = 3000];" in d.dds() and "many" in d.das()
    monkeypatch.setattr(chunks, "RUN_CELLS", 700)
    for low, high in ((0, 2999), (13, 2000), (5, 5)):
        length, body = d.dods(f"v[{low}:{high}]")
        data = b"".join(body)
        assert len(data) == length and np.frombuffer(data[-8 * (high - low + 1) :], ">f8").tolist() == values[low : high + 1]
    assert d.source.cells("v", (3,), (0,)).collect() == []


def test_inner_dimensions_and_maps(spark, tmp_path):
    """Members of 7, 3 and 5 rows of 4 numbers, in chunks of two rows."""
    names, at = {"b": 7, "c": 3, "a": 5}, 0
    rows = []
    for name, n in names.items():
        rows += [(name, k, at + k, [float(100 * (at + k) + j) for j in range(4)]) for k in range(n)]
        at += n
    table = spark.createDataFrame(rows, "name string, k int, t int, p array<float>")
    write_members(str(tmp_path / "s"), table, F.col("name"), "k", "t", F.col("t"), ["p"], {"p": ("x", 4)}, chunk_rows=8)
    side = TableSource(spark.range(4).select("id", (F.col("id") * 2.5).alias("x")), "x", "id", coordinate="x")
    d = Dataset("d", Together(MemberStore(spark, str(tmp_path / "s")), side))
    model = np.array([[100 * t + j for j in range(4)] for t in range(15)])
    for a, b, c, e in ((0, 14, 0, 3), (6, 7, 1, 2), (2, 12, 3, 3), (9, 9, 0, 0)):
        cells = sorted(map(tuple, d.grid(f"p[{a}:{b}][{c}:{e}]").select("i_t", "i_x", "value", "t", "x").collect()))
        assert cells == [(t, j, float(model[t, j]), t, j * 2.5) for t in range(a, b + 1) for j in range(c, e + 1)]
    write_members(str(tmp_path / "s"), spark.createDataFrame([("d", 0, -1, [1.0] * 4)], table.schema), F.col("name"), "k", "t", F.col("t"), ["p"], {"p": ("x", 4)}, chunk_rows=8, append=True)
    again = Dataset("d", MemberStore(spark, str(tmp_path / "s")))
    assert sorted(map(tuple, again.cells("p[0:1][0]")[0][1].collect())) == [(0, 0, 1.0), (1, 0, 0.0)]
    for bad, why in ((table, "is in the store"), (table.withColumn("p", F.col("p").cast("array<int>")), "other variables")):
        with pytest.raises(ValueError, match=why):
            write_members(str(tmp_path / "s"), bad, F.col("name"), "k", "t", F.col("t"), ["p"], {"p": ("x", 4)}, chunk_rows=8, append=True)
    with pytest.raises(Exception, match="without a member"):
        write_members(str(tmp_path / "t"), spark.createDataFrame([(None, 0, 0, [0.0])], table.schema), F.col("name"), "k", "t", F.col("t"), ["p"], {"p": ("x", 1)})


def test_an_empty_store(spark, tmp_path):
    write_members(str(tmp_path / "s"), spark.createDataFrame([], "m string, k int, t int"), F.col("m"), "k", "t", F.col("t"), ["t"])
    source = MemberStore(spark, str(tmp_path / "s"))
    assert source.total == source.n_members == 0 and source.cells("t", (0,), (0,)).collect() == []


def jobs_of(spark, work):
    tracker, name = spark.sparkContext.statusTracker(), os.urandom(4).hex()
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(tracker.getJobIdsForGroup(name))


def test_stores_anywhere_are_opened_and_joined_by_one_scan(spark, tmp_path, monkeypatch):
    """12 stores in folders of their own; opening them and finding their order are some jobs, the same for any number."""
    values = {}
    for m in range(12):
        table = spark.createDataFrame([(k, 1000 - 10 * m + k, m + k / 8) for k in range(m % 3 + 1)], "k long, t long, v double").coalesce(1)
        values[m] = [m + k / 8 for k in range(m % 3 + 1)]
        write_store(str(tmp_path / f"d{m % 7}" / f"{m}.slab"), TableSource(table, "t", "k", coordinate="t", length=m % 3 + 1))
    paths = [str(tmp_path / f"d{m % 7}" / f"{m}.slab") for m in range(12)]
    want = [x for m in reversed(range(12)) for x in values[m]]
    source, n = jobs_of(spark, lambda: JoinedSource(open_stores(spark, paths), "t"))
    few, n_few = jobs_of(spark, lambda: JoinedSource(open_stores(spark, paths[:5]), "t"))
    assert n == n_few and sum(source.sizes) == len(want) == 24
    cells = source.cells("v", (0,), (24,))
    assert [r["value"] for r in sorted(cells.collect(), key=lambda r: r["i_t"])] == want
    assert sum("FileSourceScan" in x.getClass().getSimpleName() for x in leaves(cells._jdf.queryExecution().executedPlan())) == 1
    part = source.cells("v", (1, ), (4,))
    assert [r["value"] for r in sorted(part.collect(), key=lambda r: r["i_t"])] == want[1:5] and len(part.inputFiles()) <= 3
    twice = JoinedSource(open_stores(spark, [paths[3], paths[3], paths[1]]), "t")
    assert [r["value"] for r in sorted(twice.cells("v", (0,), (4,)).collect(), key=lambda r: r["i_t"])] == values[3] * 2 + values[1]
    monkeypatch.setattr(aggregate, "LISTED", 5)
    before = source.stamp()
    os.utime(tmp_path / "d0" / "0.slab" / chunks.SCHEMA_FILE, ns=(1, 1))
    assert source.stamp() != before


def test_a_path_that_only_spark_reads(spark, many):
    path, values = many
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./m", f"file://{path}")
    source = MemberStore(spark, "viewfs://far/m")
    assert sorted(r["value"] for r in source.cells("v", (0,), (40,)).collect()) == sorted(values[:40])


def test_the_index_is_that_of_the_files(spark, tmp_path):
    """Nothing is kept in executors, and files that are read in other splits give the same index."""
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("x"), F.lit("é").alias("y"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = dense_index(rows.repartition(7), ["x"], "i", str(tmp_path / "t"))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    want = {x: k for k, x in enumerate(sorted(r["x"] for r in rows.collect()))}
    assert {r["x"]: r["i"] for r in found.collect()} == want
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "2k")
        spark.sparkContext._jsc.sc().env().blockManager().memoryStore().clear()
        again = stored_index(spark.read.parquet(str(tmp_path / "t")), "i")
        assert again.rdd.getNumPartitions() > 8 and {r["x"]: r["i"] for r in again.collect()} == want
    finally:
        spark.conf.set(key, old)
    assert dense_index(rows.limit(0), ["x"]).collect() == []


def test_files_count_in_the_order_of_their_tasks(spark):
    from slabworks.functions.index import file_order

    names = ["file:/t/part-00002-a-c000.snappy.parquet", "file:/t/part-00010-a-c001.parquet", "file:/t/part-00010-a-c000.parquet", "file:/t/part-100000-a-c000.parquet", "file:/t/part-99999-a-c000.parquet"]
    rows = spark.createDataFrame([(n,) for n in names], "f string").orderBy(file_order(F.col("f"))).collect()
    assert [r["f"] for r in rows] == [names[k] for k in (0, 2, 1, 4, 3)]


def test_ranges_of_partitioned_tables_read_their_members_only(spark, tmp_path):
    rows = [(m, k, float(100 * m + k)) for m in range(40) for k in range(m % 4 + 1)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "m int, k int, c double").repartition("m").write.partitionBy("m").parquet(path)
    table = spark.read.parquet(path)
    plans = []
    table.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    whole = sorted((r["m"], r["k"]) for r in table.collect())
    for start, count in ((3, 4), (0, 100), (50, 7)):
        found = joined_range(table, F.col("m"), F.col("c"), "k", start, count, "i")
        assert sorted((r["i"], r["m"], r["k"]) for r in found.collect()) == [(i, *whole[i]) for i in range(start, min(start + count, len(whole)))]
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert max(plans) - min(plans) < 300
