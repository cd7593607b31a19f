from itertools import permutations

from pyspark.sql import functions as F
from tables import SF, against_sql, edges

from slabworks.llm import filter_audit


def brute(docs, labels):
    """Every order, document by document."""
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    parts = {}
    for i, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": bool(set(t) & set("#$%&*|")),
            "E": i is not None and i > first.get(t, i),
        }
        parts.setdefault(lang or "", []).append((i, "".join(k for k, v in fails.items() if v)))
    out, total = {}, {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                total[part, c] = total.get((part, c), 0) + len(gone)
                redundant = sum(c in f for _, f in rows) - len(gone)
                unique = sum(f == c for _, f in rows)
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in df.collect()}


LONG = " ".join(f"w{k}" for k in range(250))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (4, LONG.upper(), ""), (4, LONG.upper(), "fr"), (5, "a " * 400, "en"),
    (6, "A $", "fr"), (7, "A $", "fr"), (None, "A $", "fr"), (None, LONG, "fr"), (8, None, "fr"), (9, "", "en"), (10, " \t", "en"), (11, "É" * 300, "de"), (12, LONG + " |", "de"), (0, LONG + " |", "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, None), (7, 1, 1), (12, 0, 1), (None, 1, 1), (99, 1, 1)]


def test_every_order_document_by_document(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    for c in ("part", "mask", "sha", "n", "good", "toxic", "id", "of", "quality", "at", "spread"):
        docs = docs.withColumn(c, F.lit(7))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    assert found(filter_audit.audit(docs, labels)) == brute(DOCS, LABELS)


def test_edge_cases_and_empty_tables(spark):
    docs = edges(spark).withColumn("lang", F.lit(None).cast("string"))
    rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found(filter_audit.audit(docs, labels)) == brute(rows, [])
    assert filter_audit.audit(docs.limit(0), labels).collect() == []


def test_polynomial_by_its_definition():
    counts = [(k * 7919) % 101 for k in range(32)]
    p = filter_audit.removal_polynomial(counts)
    for s in range(32):
        assert filter_audit.corner(p, s) == sum(n for m, n in enumerate(counts) if m & s)
    for k in range(5):
        assert filter_audit.shapley(p, k) == sum(filter_audit.Fraction(n, m.bit_count()) for m, n in enumerate(counts) if m >> k & 1)


def test_query_gives_the_rows_of_its_sql(spark):
    ours, theirs = against_sql(filter_audit.op11_filter_audit(spark, SF), filter_audit.SQL)
    assert ours == theirs and len(ours) >= 600
