"""Filter interaction audit: what each of five filters removes, in every order.

The filters' failures of a document are a mask of five bits, and all that an audit needs
is how many documents of a part have each mask. These 32 counts give the part's removal
polynomial, the multilinear extension of "documents that any filter of a set removes":
the sum over masks m of n(m) * (1 - product of (1 - x_i) over the filters i in m). At
the corner of a set of filters it is what the set removes, so corners give survivors
and what a step removes; the integral of its partial derivative along the diagonal is a
filter's Shapley value.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = 120  # of five filters
WORDS, DISTINCT, UPPER = 200, 50, 3
SPACE = r"[\x20\x09-\x0D]+"
ODD = r"[#$%&*|]"


def failures(text: Column) -> Column:
    """Bits 0 to 3: the failures that a text shows by itself."""
    words = F.array_remove(F.split(text, SPACE), "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    found = [
        F.size(words) < WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT * F.size(words).cast("long"),
        100 * upper.cast("long") > UPPER * F.length(text).cast("long"),
        text.rlike(ODD),
    ]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(found)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents of a part with a mask of failures, and those of them that the labels mark.

    A text's digest stands for it; rows are counted by id, text and part before they are
    moved, then by text, part and labels, so a group of copies is a few rows wherever it is gathered.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), content.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), failures(F.col("text")).alias("mask"))
    rows = rows.groupBy("id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n"))
    # rows without an id meet no label; the second key deals them out
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("sha"), F.lit(1 << 20)).cast("int")).otherwise(0))
    known = known.withColumn("at", F.lit(0))
    rows = rows.join(known, (F.col("id") == F.col("of")) & (F.col("spread") == F.col("at")), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = rows.select("id", "part", "sha", "mask", "n", flag("good"), flag("toxic"))
    copies = rows.groupBy("sha", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("id").alias("least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("of_least"),  # an id's rows are one row here
    )
    copies = copies.withColumn("first", F.min("least").over(Window.partitionBy("sha")))
    copies = copies.withColumn("stays", F.col("no_id") + F.when(F.col("least").eqNullSafe(F.col("first")), F.col("of_least")).otherwise(0))
    stays = F.col("stays")
    both = F.array(F.struct(F.col("mask").alias("mask"), stays.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - stays).alias("n")))
    split = copies.select("part", "good", "toxic", F.explode(both).alias("m"))
    return split.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum("m.n").alias("n"), F.sum(F.when(F.col("good"), F.col("m.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("m.n")).otherwise(0)).alias("toxic")
    )


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients by monomial (a set of filters, as bits) of the multilinear extension of what sets of filters remove."""
    out = [0] * MASKS
    for mask, n in enumerate(counts):
        out[0] += n
        s = mask
        while True:  # - n * product of (1 - x_i), written out
            out[s] -= n if s.bit_count() % 2 == 0 else -n
            if not s:
                break
            s = (s - 1) & mask
    return out


def corner(polynomial: list[int], filters: int) -> int:
    """Its value where the filters of the set are 1 and the others 0."""
    return sum(c for s, c in enumerate(polynomial) if s & filters == s)


def shapley(polynomial: list[int], k: int) -> Fraction:
    """The integral over t of its partial derivative by filter ``k`` where every variable is t."""
    derivative = [Fraction(0)] * len(FILTERS)  # by power of t
    for s, c in enumerate(polynomial):
        if s >> k & 1:
            derivative[s.bit_count() - 1] += c
    return sum((c / (power + 1) for power, c in enumerate(derivative)), Fraction(0))


_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every = MASKS - 1
    for batch in batches:
        for row in batch.to_pylist():
            n, good, toxic = ([0] * MASKS for _ in range(3))
            for m in row["masks"]:
                n[m["mask"]], good[m["mask"]], toxic[m["mask"]] = m["n"], m["good"], m["toxic"]
            total = sum(n)
            corners = [[corner(p, s) for s in range(MASKS)] for p in map(removal_polynomial, (n, good, toxic))]
            values = [shapley(removal_polynomial(n), k) * ORDERS for k in range(len(FILTERS))]
            out = []
            for order in permutations(range(len(FILTERS))):
                before = 0
                for step, k in enumerate(order, 1):
                    after = before | 1 << k
                    removed, good_lost, toxic_lost = (c[after] - c[before] for c in corners)
                    alone = corners[0][every] - corners[0][every & ~(1 << k)]
                    name = "".join(FILTERS[i] for i in order)
                    out.append((row["part"], name, step, total - corners[0][after], removed, corners[0][1 << k] - removed, alone, good_lost, toxic_lost, int(values[k])))
                    before = after
            names = [c.split()[0] for c in _RESULT.split(", ")]
            types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """600 rows of each part: its 120 orders of the filters, step by step.

    Filters, by what fails them: A under 200 words; B fewer distinct words than half; C
    more than 3 capitals A-Z in 100 code points; D a character of ``#$%&*|``; E a text
    that a row with a smaller id has too, in any part. Null texts count as empty, which
    fail A alone (and E, if there are several); null parts are the part of the empty
    string. Rows without an id never fail E and make no other row fail it, and have no
    label; rows that repeat an id and a text are each other's equals, neither fails E
    by the other. An id with several labels counts as marked if one of them marks it.
    Words keep their case. Very long texts are read where they lie: only digests and
    masks are moved. Other columns aren't read; no rows give no rows. Shapley values
    are whole numbers after the scaling by 120, and exact.
    """
    counts = mask_counts(docs, labels, id_col, text, part)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    return parts.mapInArrow(_audit_rows, _RESULT)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""WITH marked AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY 1
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), least AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY 1
), failing AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, {
    'A': len(words) < 200,
    'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text),
    'D': regexp_matches(t.text, '[#$%&*|]'),
    'E': coalesce(t.doc_id > l.first, false)} AS f
  FROM texts t JOIN least l ON t.text = l.text LEFT JOIN marked m ON t.doc_id = m.doc_id
), masks AS (
  SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
    || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failing GROUP BY 1, 2
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || x.c || d.c || e.c AS filter_order FROM letters a, letters b, letters x, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, x.c, d.c, e.c])) = 5
), steps AS (
  SELECT p.part, filter_order, step, filter_order[step] AS c, filter_order[1:step - 1] AS earlier FROM (SELECT DISTINCT part FROM masks) p, orders, range(1, 6) s(step)
), counted AS (
  SELECT s.part, s.filter_order, s.step::INT AS step, s.c,
    sum(CASE WHEN hit OR before THEN 0 ELSE n END)::BIGINT AS kept,
    sum(CASE WHEN hit AND NOT before THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN hit AND before THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = s.c THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT before THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN hit AND NOT before THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM (SELECT s.*, m.*, contains(m.mask, s.c) AS hit, (m.mask <> '' AND s.earlier <> '' AND regexp_matches(m.mask, '[' || s.earlier || '_]')) AS before
    FROM steps s JOIN masks m ON s.part = m.part) s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM counted"""
