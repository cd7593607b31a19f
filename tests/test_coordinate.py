import pytest
from pyspark.sql import functions as F

from slabworks.operators.coordinate import segment_cells, segments

BIG = (1 << 63) - 1
CASES = {
    "int": [[0, 1, 2, 3], [10, 8, 6], [7], [5, 5, 5], [1, 2, 4], [2**31 - 1, -(2**31)], []],
    "bigint": [[BIG - 2, BIG - 1, BIG], [BIG, -BIG], [-BIG, 0, BIG], [0, 6, 12, 18]],
    "smallint": [[32767, -32768], [-3, -1, 1]],
    "double": [[0.0, 0.1, 0.2, 0.30000000000000004], [0.0, 0.1, 0.2, 0.3], [1.5, 2.5, 3.5], [float("nan"), float("nan")], [0.0, -0.0, 0.0], [float("inf"), float("inf")], [1e308, -1e308, 1e308]],
    "float": [[0.5, 0.75, 1.0], [0.1, 0.2, 0.3]],
    "decimal(20,0)": [[1, 2, 3], [2**64 - 1]],
}


@pytest.mark.parametrize("kind", list(CASES))
def test_each_value_comes_back(spark, kind):
    rows, at = [], 0
    for values in CASES[kind]:
        rows.append((at, values))
        at += len(values)
    from decimal import Decimal

    given = [(i, [Decimal(x) for x in v] if kind.startswith("dec") else v) for i, v in rows]
    stretches = spark.createDataFrame(given, f"at long, payload array<{kind}>")
    stored = segments(stretches, kind)
    want = [(i + k, str(r)) for i, v in ((r["at"], r["payload"]) for r in stretches.collect()) for k, r in enumerate(v)]
    for start, count in ((0, at), (1, 3), (at - 1, 1), (2, 0)):
        found = segment_cells(stored, "i_t", "int", kind, start, count)
        assert found.dtypes == [("i_t", "int"), ("value", kind)]
        assert sorted((r["i_t"], str(r["value"])) for r in found.collect()) == want[start : start + count]
    regular = {r["at"] for r in stored.where("values IS NULL").collect()}
    if kind == "int":
        assert regular == {0, 4, 7, 8}
    if kind == "bigint":
        assert regular == {0, 8}  # steps that don't fit a long aren't taken


def test_a_regular_coordinate_takes_a_row_for_each_stretch(spark):
    stretches = spark.range(20).select((F.col("id") * 50_000).alias("at"), F.sequence(F.col("id") * 50_000, F.col("id") * 50_000 + 49_999).alias("payload"))
    stored = segments(stretches, "bigint")
    assert stored.count() == 20 and stored.where("values IS NULL AND step = 1").count() == 20
    assert [tuple(r) for r in segment_cells(stored, "i", "int", "bigint", 99_998, 4).orderBy("i").collect()] == [(k, k) for k in range(99_998, 100_002)]
