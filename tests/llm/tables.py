"""Small inputs that several tests use."""

import duckdb

SF = "/root/testdata/sf0.001"


def rows(table="documents", columns="doc_id, text", sf=SF):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{sf}/{table}.parquet'").fetchall()


def against_sql(found, sql, sf=SF, **frames):
    """The DataFrame's rows and the SQL's, sorted, with columns in the order of their names."""
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, frame in frames.items():
        con.register(name, frame)
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    order = sorted(names)
    assert order == sorted(found.columns)
    return sorted(map(str, ([r[c] for c in order] for r in found.collect()))), sorted(map(str, ([r[names.index(c)] for c in order] for r in theirs.fetchall())))


#: Nulls in every column, empty texts, ties, repeated rows, a long text.
EDGES = [(5, "a b c d e"), (3, "a  b c d e"), (3, "a  b c d e"), (None, "a b c d e"), (None, None), (7, ""), (8, " \t\n"), (None, "zz"), (None, "zz"), (9, "x" * 200_000), (10, "word " * 30_000), (11, "é ü ▁ \U0001f600 </s>")]


def edges(spark, more=()):
    """The edge cases with other columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([*EDGES, *more], "doc_id long, text string")
    for c in ("id", "key", "row", "words", "score", "label", "fp", "recipe", "kept", "h", "__key", "__n", "__hash", "__slot", "__arc", "__rank", "__row", "__of", "__maybe", "a.b"):
        df = df.withColumn(c, F.lit(None).cast("int"))
    return df
