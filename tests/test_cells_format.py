import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import NumpySource, cube

from slabworks.sources import cells_format
from slabworks.sources.chunks import write_store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "s")
    arrays = {"a": ("Int16", ("lat", "lon"), cube((13, 9), "Int16", -5)), "b": ("UInt64", (), np.array(7, "u8"))}
    write_store(path, NumpySource(spark, arrays), chunks={"a": (4, 2)})
    cells_format.register(spark)
    return path, arrays["a"][2]


@pytest.mark.parametrize(
    "where",
    ["i_lat BETWEEN 3 AND 9", "i_lon = 4 AND i_lat > 10", "i_lon IN (1, 8) AND i_lat < 2", "i_lat >= 5 AND value % 2 = 0", "i_lat > 20", "i_lat = 3 OR i_lon = 2", "i_lat = 3 AND (i_lon <= 1 OR value < 0)", "true", "i_lat IN (1, NULL)", "value IS NULL", "i_lat < 3 AND i_lat > 7"],
)
def test_predicates_on_indices_are_boxes(spark, store, where):
    path, a = store
    found = spark.read.format("array_cells").option("variable", "a").load(path)
    model = spark.createDataFrame([(i, j, int(x)) for (i, j), x in np.ndenumerate(a)], "i_lat int, i_lon int, value smallint")
    assert sorted(map(tuple, found.where(where).collect())) == sorted(map(tuple, model.where(where).collect()))


def test_only_chunks_of_the_box_are_read(store):
    path, _ = store
    source = cells_format.CellsDataSource({"path": path, "variable": "a"})
    reader = source.reader(None)
    left = list(reader.pushFilters([cells_format.GreaterThanOrEqual(("i_lat",), 5), cells_format.LessThan(("i_lat",), 8), cells_format.EqualTo(("i_lon",), 3), cells_format.EqualTo(("value",), 1)]))
    assert [f.attribute for f in left] == [("value",)] and (reader.low, reader.high) == ([5, 3], [7, 3])
    assert reader.wanted() == [("c_0", ">=", 1), ("c_0", "<=", 1), ("c_1", ">=", 1), ("c_1", "<=", 1)]
    rows = sum(cells_format.pq.read_table(p, filters=reader.wanted()).num_rows for part in reader.partitions() for p in part.paths)
    assert rows == 1


def test_views_scalars_and_errors(spark, store):
    path, a = store
    spark.read.format("array_cells").option("variable", "a").load(path).createOrReplaceTempView("cells_of_a")
    assert spark.sql("SELECT sum(value) FROM cells_of_a WHERE i_lat = 2").first()[0] == int(a[2].sum())
    assert [int(r["value"]) for r in spark.read.format("array_cells").option("variable", "b").load(path).collect()] == [7]
    for options in ({}, {"variable": "none"}):
        with pytest.raises(Exception, match="variable must be one of a, b"):
            spark.read.format("array_cells").options(**options).load(path).count()
