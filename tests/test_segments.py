import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import NumpySource, cube

from slabworks.sources.base import Dataset
from slabworks.streaming import segments


@pytest.fixture(scope="module")
def dataset(spark):
    arrays = {"y": ("Float64", ("y",), cube((9,), "Float64")), "x": ("Int16", ("x",), cube((7,), "Int16", -3)), "P": ("Float32", ("y", "x"), cube((9, 7), "Float32")), "one": ("Int32", (), np.array(5, "i4"))}
    return Dataset("d", NumpySource(spark, arrays))


@pytest.mark.parametrize("text", [None, "P[2:8][1:5]", "P.P[3][2],one", "x[6]"])
def test_segments_put_together_are_the_response(dataset, tmp_path, text):
    length, body = dataset.dods(text)
    want = b"".join(body)
    assert segments.write_dods(dataset, text, f"file://{tmp_path}") == length
    assert b"".join(segments.read_dods(str(tmp_path))) == want
    for a, b in ((0, 5), (3, len(want) - 1), (len(want) - 9, None), (50, 51), (len(want), None)):
        assert b"".join(segments.read_dods(str(tmp_path), a, b)) == want[a:b]


def test_many_segments(spark, tmp_path):
    n = 40_000
    cells = spark.range(n).select(F.col("id").cast("int").alias("i_t"), (F.col("id") % 1000).cast("int").alias("value")).repartition(5)
    from slabworks.plans.schema import TYPES, Leaf

    leaf = Leaf("t", TYPES["Int32"], (("t", n),), (0,), (n,))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    segments.write_leaf(cells, leaf, ["i_t"], f"file://{tmp_path}/0")
    spark.conf.unset(key)
    parts = [f for f in os.listdir(tmp_path / "0") if "json" not in f]
    rows = segments.stored_payload(spark, f"file://{tmp_path}", 0).collect()
    assert len(parts) == len(rows) > 1
    data = b"".join(bytes(r["payload"]) for r in sorted(rows, key=lambda r: r["first"]))
    assert np.array_equal(np.frombuffer(data, ">i4"), np.arange(n) % 1000)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    from slabworks.plans.schema import TYPES, Leaf

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([b"12345678"])], ["first", "payload"])

    def lost():
        yield batch
        raise RuntimeError("lost")

    writer = segments.SegmentWriter(str(tmp_path / "0"), 4, 4)
    done = writer.write(iter([batch]))
    with pytest.raises(RuntimeError):
        writer.write(lost())
    assert len(os.listdir(tmp_path / "0")) == 2
    writer.abort([done, None])
    assert os.listdir(tmp_path / "0") == []
    with pytest.raises(ValueError, match="doesn't follow"):
        writer.write(iter([batch, batch]))
    short = Leaf("t", TYPES["Int32"], (("t", 2000),), (0,), (1500,))
    with pytest.raises(Exception, match="bytes of 6000"):
        segments.write_leaf(spark.range(1000).select(F.col("id").cast("int").alias("i_t"), F.lit(1).alias("value")), short, ["i_t"], f"file://{tmp_path}/1")
    assert os.listdir(tmp_path / "1") == []
