import base64
import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import SF as SMALL
from tables import edges, rows

from slabworks.llm import language_id as m

SF = "/root/testdata/sf0.01"


def fit(texts, languages):
    return m.fit(np.array([m.features(t) for t in texts]), languages)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = m.op7_language_id(spark, SF)
    assert found.count() == docs.count()
    row = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert row[0] >= 0.98 and 0 <= row[1] <= row[2] <= 1


def test_labels_and_ids_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    train = docs.where(m.fold(F.col("doc_id"), 3) != 1)
    a = m.train(train)
    b = m.train(train.withColumn("source", F.lit("x")).withColumn("doc_id", F.col("doc_id")))
    assert np.allclose(a.weights, b.weights) and a.languages == ["de", "en", "es", "fr"]


def plain_features(text):
    raw, grams = text.lower().encode(errors="replace"), collections.Counter()
    for n in range(1, 5):
        for k in range(len(raw) - n + 1):
            grams[(int.from_bytes(raw[k : k + n], "big") + n) * 2654435761 % 2**32 >> 32 - m.BITS] += 1
    x = np.zeros(1 << m.BITS)
    for k, v in grams.items():
        x[k] = v**0.5
    return x / np.linalg.norm(x)


def test_query_against_a_plain_model(spark):
    """Every row of the query: features gram by gram, least squares over all weights, each codeword's loss by itself."""
    docs = rows(columns="doc_id, text, lang")
    learnt = [(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 3 != 1 and t and lang and m.has_letter(t)]
    names = sorted({lang for _, lang in learnt})
    code = m.codewords(len(names))
    x, y = np.array([plain_features(t) for t, _ in learnt]), np.array([code[names.index(lang)] for _, lang in learnt])
    share = np.array([1 / sum(lang == other for _, other in learnt) for _, lang in learnt])
    share *= len(learnt) / share.sum()
    # ridge with an intercept that isn't penalised, by the normal equations
    one = np.column_stack([x, np.ones(len(x))])
    gram = one.T @ (one * share[:, None])
    gram[np.arange(x.shape[1]), np.arange(x.shape[1])] += m.RIDGE
    w = np.linalg.solve(gram, one.T @ (y * share[:, None]))
    found = {r["doc_id"]: r for r in m.op7_language_id(spark, SMALL).collect()}
    assert set(found) == {i for i, *_ in docs}
    for i, t, _ in docs:
        if not t or not m.has_letter(t):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0)
            continue
        margins = np.append(plain_features(t), 1) @ w
        loss = [sum(math.exp(-min(max(a * b, -2), 2)) for a, b in zip(margins, word)) for word in code]
        odds = [math.exp(-m.SHARPNESS * (v - min(loss)) / len(code[0]) ** 0.5) for v in loss]
        assert found[i]["lang_pred"] == names[int(np.argmin(loss))] and found[i]["score"] == pytest.approx(max(odds) / sum(odds), abs=1e-3)
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_far_texts_are_rejected_by_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    far = ["这是一个关于语言识别的测试文本，我们希望它被拒绝。" * 4, "Это тест для определения языка, который должен быть отклонён. " * 3, base64.b64encode(random.Random(1).randbytes(300)).decode()]
    short = ["这是文本", "Это тест"]
    more = spark.createDataFrame([(10_000_000 + k, t) for k, t in enumerate([*far, *short])], "doc_id long, text string")
    more = docs.unionByName(more, allowMissingColumns=True)
    kept = m.keep_known(more)
    assert kept.count() == docs.count() + len(short) and kept.where("doc_id >= 10000003").count() == 2
    assert m.keep_known(more.withColumn("lang", F.lit(None).cast("string"))).count() == more.count()  # no model, no decision


def test_codewords():
    for k in (1, 2, 3, 4, 5, 7, 8, 20, 60):
        code = m.codewords(k)
        assert code.shape[0] == k and set(np.unique(code)) <= {-1.0, 1.0}
        if k > 1:
            apart = (code.shape[1] - code @ code.T) / 2 + 1e9 * np.eye(k)
            assert apart.min() >= (1 if k == 2 else code.shape[1] / 4)
    assert m.codewords(4).shape == (4, 7)


def test_wrong_bits_are_corrected_and_doubt_is_flagged():
    code = m.codewords(4)
    model = m.Model(list("abcd"), code, np.eye(7, dtype=np.float32), np.zeros(7, np.float32))
    flipped = code.copy()
    flipped[:, 2] *= -1
    best, score, unsure, _ = model.decode(flipped)
    assert best.tolist() == [0, 1, 2, 3] and not unsure.any() and (score > 0.75).all()
    _, score, unsure, _ = model.decode((code[:1] + code[1:2]) / 2)
    assert unsure.all() and score[0] < 0.75


def test_whole_texts_count():
    assert not np.allclose(m.features("the end " * 5000), m.features("the end " * 5000 + "être ça où " * 5000))
    assert m.features("").sum() == 0 and np.isclose(np.linalg.norm(m.features("a")), 1)


def test_edges(spark):
    df = edges(spark, [(30, "123 !?"), (31, "½ ²")]).withColumn("lang", F.when(F.col("doc_id") > 3, "x"))
    model = fit(["a b c", "das ist"], ["en", "de"])
    found = {}
    for r in m.predict(df, model).collect():
        found.setdefault(r["doc_id"], []).append((r["lang_pred"], r["rejected"], r["score"]))
    assert found[7] == found[8] == found[30] == found[31] == [("und", True, 0.0)] and ("und", True, 0.0) in found[None]
    assert all(lang in ("en", "de") and 0 <= s <= 1 for k in (3, 5, 9, 10, 11) for lang, _, s in found[k])
    kept = m.keep_known(df)
    assert kept.columns == df.columns and kept.count() == df.count() - 5
    unknown = m.predict(df, None).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"} and sum(not r["rejected"] for r in unknown) == kept.count()
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert m.train(none) is None and m.keep_known(none).count() == kept.count()
    assert m.predict(df.limit(0), model).count() == 0 and m.keep_known(df.limit(0)).count() == 0
    one = fit(["a", "b"], ["en", "en"])
    assert {r["lang_pred"] for r in m.predict(df, one).collect()} == {"en", "und"}


def test_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = {r["lang"]: r["count"] for r in m.training_rows(docs, "doc_id", "text", "lang", per_language=20).groupBy("lang").count().collect()}
    assert n == {"de": 20, "en": 20, "es": 20, "fr": 20}
    assert m.training_rows(docs, "doc_id", "text", "lang", most=8).count() == 8


def test_sample_takes_an_id_once_and_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(5)
    docs = [(k, f"text {k} {j}", f"l{k % 2}") for k in range(300) for j in range(rng.choice([1, 1, 4]))] + [(7, "text 7 0", "l1")] * 500 + [(8, "only", "l2")] * 100
    found = []
    for parts in (1, 6):
        rng.shuffle(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(parts)
        got = sorted(map(tuple, m.training_rows(df, "doc_id", "text", "lang", per_language=100).collect()))
        assert collections.Counter(g[0] for g in got) == {"l0": 100, "l1": 100, "l2": 1} and len({(g[0], g[1]) for g in got}) == 201
        found.append(got)
    assert found[0] == found[1]
