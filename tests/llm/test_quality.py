import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import edges, rows

from slabworks.llm import quality as m
from slabworks.llm.common import maybe, scratch

SF = "/root/testdata/sf0.01"


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_ranking(spark):
    found = m.op1_quality(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 1000
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    assert area(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) > 0.97
    assert np.mean([r[1] == r[2] for r in rows]) > 0.93 and all(0 <= r[0] <= 1 for r in rows)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held_out = m.fold(F.col("doc_id"), 3) == 1
    turned = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (m.train(docs.where(~held_out), x.where(~held_out)) for x in (labels, turned))
    assert np.array_equal(a.weight, b.weight) and a.slope == b.slope


def by_hand(raw):
    """Indices of a text's indicators, n-gram by n-gram."""
    wrap = 1 << 32
    index = lambda g, n, bits: (g + n) * 2654435761 % wrap >> 32 - bits
    out = {m.BIAS}
    for n in range(1, 5):
        for k in range(len(raw) - n + 1):
            out.add(index(int.from_bytes(raw[k : k + n], "big"), n, m.BYTE_BITS))
    kinds = []
    for b in raw:
        kind = " " if b in b" \t\n\r\v\f" else "a" if b >= 128 or chr(b).islower() else "A" if chr(b).isupper() else "0" if chr(b).isdigit() else chr(b)
        if kinds[-1:] != [kind]:
            kinds.append(kind)
    for n in range(2, 7):
        for k in range(len(kinds) - n + 1):
            g = 0
            for c in kinds[k : k + n]:
                g = (g * 131 + ord(c)) % wrap
            out.add((1 << m.BYTE_BITS) + index(g, n, m.CLASS_BITS))
    words = raw.split()
    same = sum(a == b for a, b in zip(words, words[1:]))
    level = min(m.REPEATS - 1, max(1, m.REPEATS - 1 + math.floor(math.log2(same / len(words))))) if same else 0
    return out | {(1 << m.BYTE_BITS) + (1 << m.CLASS_BITS) + k for k in range(level + 1)} if raw else out


def test_query_against_a_plain_model(spark):
    """Every row of the query, from features, counts, descent and curve written out plainly."""
    sf = "/root/testdata/sf0.001"
    docs = dict(rows())
    labels = dict(rows("labels", "doc_id, quality"))
    ids = [i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1]
    have = {i: by_hand((t or "").encode()) for i, t in docs.items()}
    n = np.ones((2, m.SIZE))
    for i in ids:
        for k in have[i]:
            n[labels[i], k] += 1
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.xxhash64("i")).collect()}
    turns = [sorted((i for i in ids if labels[i] == c), key=lambda i: (hashes[i], i)) for c in (0, 1)]
    order = [i for pair in itertools.zip_longest(*turns) for i in pair if i is not None]
    y = np.array([1 if labels[i] else -1 for i in order])
    x = np.zeros((len(order), m.SIZE))
    for k, i in enumerate(order):
        x[k, list(have[i])] = ratio[list(have[i])]
    x /= np.linalg.norm(x, axis=1)[:, None]

    def fitted(part):
        a, z, alpha, w, rng = x[part], y[part], np.zeros(len(part)), np.zeros(m.SIZE), np.random.default_rng(0)
        for _ in range(m.EPOCHS):
            moved = 0
            for k in rng.permutation(len(part)):
                new = min(max(alpha[k] - (z[k] * (w @ a[k]) - 1), 0), m.COST * len(part) / (2 * (z == z[k]).sum()))
                w += (new - alpha[k]) * z[k] * a[k]
                moved, alpha[k] = max(moved, abs(new - alpha[k])), new
            if moved < 1e-3:
                break
        return w

    every, margins = np.arange(len(order)), np.zeros(len(order))
    for half in (0, 1):
        margins[every % 2 == half] = x[every % 2 == half] @ fitted(every[every % 2 != half])
    p1 = np.mean([labels[i] for i in ids])
    weight = np.where(y > 0, p1 / (y > 0).sum(), (1 - p1) / (y < 0).sum()) * len(y)
    slope, offset = m.calibrate(margins, y, weight)  # its own test is below
    w = fitted(every)
    found = {r["doc_id"]: r for r in m.op1_quality(spark, sf).collect()}
    assert set(found) == set(docs)
    for i in docs:
        at = list(have[i])
        want = 1 / (1 + math.exp(-(slope * (w[at] @ ratio[at]) / np.linalg.norm(ratio[at]) + offset)))
        assert found[i]["score"] == pytest.approx(want, abs=1e-4)
        assert found[i]["predicted"] == (found[i]["score"] >= 0.5) and found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_the_curve_has_the_least_loss():
    rng = np.random.default_rng(3)
    margins, weight = rng.normal(size=200), rng.random(200)
    y = np.where(rng.random(200) < 1 / (1 + np.exp(-2 * margins + 0.5)), 1, -1)

    def loss(a, b):
        return (weight * np.logaddexp(0, -y * (a * margins + b))).sum() + 5e-4 * (a * a + b * b)

    a, b = m.calibrate(margins, y, weight)
    assert all(loss(a, b) <= loss(a + da, b + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_one_plan_moves_only_labelled_texts(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(2000)] + [(7, "more of seven")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 2000, 10)] + [(7, 1)], "doc_id long, quality int")
    passed = maybe(docs, F.col("doc_id"), labels, F.col("doc_id")).where("__maybe")
    assert {r["doc_id"] for r in passed.collect()} == {*range(0, 2000, 10), 7}  # by chance no two hashes agree here
    with scratch(spark) as save:
        rows = m.labelled_texts(docs, labels, "doc_id", "text", "quality", save)
        assert rows.count() == 202 and rows.where("id = 7").count() == 2
        assert m.fit_sample(rows, 60).groupBy("label").count().where("count = 60").count() == 1 and m.fit_sample(rows, 60).count() == 61


def test_the_fit_is_bounded_by_features():
    found = [(h, np.packbits(m.indicators(f"some text {h}".encode())).tobytes(), h % 2) for h in range(20)]
    whole = m.in_fit(found)
    assert len(whole) == 20 and [y for _, y in whole] == [0, 1] * 10
    sizes = [len(r) for r, _ in whole]
    assert len(m.in_fit(found, sum(sizes[:7]))) == 7 and len(m.in_fit(found, 1)) == 2


def test_ratios_are_those_of_counting(spark):
    rows = [("good text here", 1), ("good words", 1), ("BAD!! BAD!!", 0), (None, 0)]
    n = np.ones((2, m.SIZE))
    for t, y in rows:
        n[y][m.features((t or "").encode())] += 1
    want = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    df = spark.createDataFrame(rows, "text string, label int").repartition(3)
    assert np.allclose(m.log_ratios(df), want)


def test_descent_meets_the_optimum():
    """At the optimum no multiplier can move: the dual's projected gradient vanishes."""
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(40, 6, replace=False)).astype(np.int32) for _ in range(60)]
    y = np.where([(r < 20).sum() > 3 for r in rows], 1, -1)
    scale = rng.normal(size=40) + 2
    w = m.descend(rows, y, scale, epochs=3000)
    x = np.zeros((60, 40))
    for k, r in enumerate(rows):
        x[k, r] = m.unit(scale[r])
    share = {c: 60 / (2 * (y == c).sum()) for c in (-1, 1)}

    def primal(v):
        return v @ v / 2 + sum(share[c] * max(0, 1 - c * (v @ a)) for a, c in zip(x, y))

    best = primal(w)
    assert all(best <= primal(w + step * d) + 1e-2 for step in (0.01, 0.1, 1) for d in rng.normal(size=(50, 40)))


def test_edges(spark):
    df = edges(spark)
    labels = spark.createDataFrame([(3, 1, "a"), (3, 1, "a"), (5, None, "a"), (None, 1, "a"), (7, 0, "a"), (10, 0, None), (99, 1, "a"), (11, 7, "a")], "doc_id long, quality int, text string")
    model = m.train(df, labels)
    found = m.score(df, model)
    assert found.count() == df.count() and all(0 <= r["score"] <= 1 for r in found.collect())
    assert {r["score"] for r in m.score(df, None).collect()} == {0.5} and m.train(df, labels.limit(0)) is None and m.train(df.limit(0), labels) is None
    assert m.score(df.limit(0), model).count() == 0
    one = m.train(df, labels.where("quality = 1"))
    assert all(r["score"] > 0.5 for r in m.score(df, one).collect())


def test_whole_texts_count():
    tail = m.features(b"plain words " * 20_000 + b"@@## ")
    assert len(np.setdiff1d(tail, m.features(b"plain words " * 20_000))) > 0
    assert m.features(b"").tolist() == [m.BIAS]
