import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import edges, rows

from slabworks.llm import toxicity as t


def test_steps_are_those_of_the_published_rule():
    """Against one coordinate at a time, in dictionaries."""
    rng = random.Random(3)
    learner = t.Ftrl(alpha=0.3, beta=1.0, l1=0.4, l2=0.2, size=50)
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 50 else 0.4
        return 0.0 if abs(z.get(i, 0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.2)

    for _ in range(300):
        row, y, c = sorted(rng.sample(range(50), 6)), rng.randint(0, 1), rng.choice([0.5, 2.0])
        learner.learn(np.array(row), y, c)
        on = [*row, 50]
        w = {i: weight(i) for i in on}
        g = (1 / (1 + math.exp(-sum(w.values()))) - y) * c
        for i in on:
            s = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / 0.3
            z[i], n[i] = z.get(i, 0) + g - s * w[i], n.get(i, 0) + g * g
    assert np.allclose(learner.weights(np.arange(51)), [weight(i) for i in range(51)])
    assert (learner.weights(np.arange(51)) == 0).any()


def word_hash(word):
    return sum((b + 1) * pow(t._FACTOR, k, 1 << 64) for k, b in enumerate(word)) % (1 << 64)


@pytest.mark.parametrize("block", [t.BLOCK, 12])
def test_hashes_of_words_don_t_depend_on_their_place(monkeypatch, block):
    monkeypatch.setattr(t, "BLOCK", block)
    text = "Zut, alors! é-é naïve x" * 20 + " \n" + "Longer" * 1 + " 12a"
    raw = text.encode()
    import re

    words = [w for w in re.findall(rb"[0-9a-z\x80-\xff]+", raw.lower())]
    whole, stem = t.word_hashes(raw)
    assert [int(h) for h in whole] == [word_hash(w) for w in words]
    assert [int(h) for h in stem] == [word_hash(w[: t.STEM]) for w in words]


def test_features_of_a_word_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 8)
    a, b = (t.word_hashes(f"one {w} two".encode()) for w in ("x" * 30, "x" * 31))
    assert [len(x) for x in (*a, *b)] == [3, 3, 3, 3]
    assert a[0][1] != b[0][1] and a[1][1] == b[1][1] == word_hash(b"xxxxx")


def test_pairs_with_words_between():
    near, far = (set(t.features(x.encode()).tolist()) for x in ("a b c d", "a x c d"))
    one, none = (set(t.features(x.encode()).tolist()) for x in ("a q c", "c q a"))
    assert near & far & one - set(t.features(b"a c").tolist())  # "a _ c"
    assert len(near) == 4 + 4 + 3 + 2 + 1 and one != none and t.features(b" .,").size == 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in t.op12_toxicity(spark, sf).collect()}
    label = dict(rows("labels", "doc_id, toxic", sf))
    assert len(found) == duckdb.connect().execute(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchone()[0]
    held = [(r["predicted"], label[i]) for i, r in found.items() if r["held_out"] and i in label]
    wrong = [p for p, y in held if p != y and y == 0]
    caught = [p for p, y in held if y == 1]
    assert len(held) > 800 and sum(caught) >= 0.85 * len(caught) and len(wrong) <= 0.01 * len(held)
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in found.values())


def test_weights_are_few(spark):
    docs, labels = (spark.createDataFrame(x, kind) for x, kind in (([(i, f"fine word{i} {'vile' if i % 2 else 'nice'}") for i in range(200)], "doc_id long, text string"), ([(i, i % 2) for i in range(200)], "doc_id long, toxic int")))
    model = t.train(docs, labels)
    assert 0 < len(model.at) < 40
    score = {r["doc_id"]: r["score"] for r in t.score(docs, model).collect()}
    assert min(s for i, s in score.items() if i % 2) > 0.5 > max(s for i, s in score.items() if not i % 2)
    assert len(t.train(docs, labels, most=20).at) < len(model.at)


def test_edge_cases(spark):
    docs = edges(spark)
    labels = spark.createDataFrame([(5, 1), (5, 0), (3, 0), (7, None), (None, 1), (9, 0), (10, 1), (8, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = t.train(docs, labels)
    found = [(r["doc_id"], r["score"]) for r in t.score(docs, model).collect()]
    assert sorted(map(str, (i for i, _ in found))) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert len({s for i, s in found if i in (7, 8)}) == 1 and all(0 <= s <= 1 for _, s in found)
    assert t.train(docs, labels.limit(0)) is None and t.train(docs.limit(0), labels) is None
    assert {r["score"] for r in t.score(docs, None).collect()} == {0.0}
    assert t.score(docs.limit(0), model).collect() == []
    assert t.train(docs, labels.where("toxic = 0")) is not None
