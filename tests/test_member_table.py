import shutil

from pyspark.sql import functions as F

from slabworks.sources.members import MemberStore, opened, write_members
from slabworks.streaming.member_table import follow, followed


def rows_of(df):
    return sorted(map(tuple, df.select("member", "n", "rank", "ordinal", "member_start").collect()))


def test_members_that_are_added_count_once(spark, tmp_path):
    store, table, checkpoint = (f"file://{tmp_path}/{n}" for n in ("store", "table", "checkpoint"))

    def add(names, append=True):
        rows = spark.createDataFrame([(n, k, 100 * at + k) for n, at, size in names for k in range(size)], "name string, k int, t int")
        write_members(store, rows, F.col("name"), "k", "t", F.col("t"), ["t"], chunk_rows=2, append=append)

    def run(files=1000):
        query = follow(spark, store, table, checkpoint, files=files)
        query.awaitTermination()
        return query.lastProgress

    add([("b", 5, 3), ("c", 2, 7)], append=False)
    run()
    assert rows_of(followed(spark, table)) == [("b", 3, 500.0, 1, 7), ("c", 7, 200.0, 0, 0)]
    for names in ([("a", 9, 1)], [("d", 0, 4), ("e", 3, 2)], [("f", 1, 1)]):
        add(names)
        run(files=1)  # several batches
        source = MemberStore(spark, store)
        assert rows_of(followed(spark, table)) == rows_of(opened(spark, store, source.book))
    before = rows_of(followed(spark, table))
    run()  # nothing is new
    assert rows_of(followed(spark, table)) == before
    source = MemberStore(spark, store, followed(spark, table))
    assert [r["value"] for r in sorted(source.cells("t", (0,), (source.total,)).collect(), key=lambda r: r["i_t"])] == [0, 1, 2, 3, 100, *range(200, 207), 300, 301, 500, 501, 502, 900]


def test_a_batch_that_runs_again_replaces_its_counts(spark, tmp_path):
    store, table = (f"file://{tmp_path}/{n}" for n in ("store", "table"))
    rows = spark.createDataFrame([("a", k, k) for k in range(5)], "name string, k int, t int")
    write_members(store, rows, F.col("name"), "k", "t", F.col("t"), ["t"])
    follow(spark, store, table, f"file://{tmp_path}/c").awaitTermination()
    shutil.rmtree(tmp_path / "c")  # as if the first batch had ended without being noted
    follow(spark, store, table, f"file://{tmp_path}/c").awaitTermination()
    assert [(r["member"], r["n"]) for r in followed(spark, table).collect()] == [("a", 5)]
