import math
import random
import re
import time

from tables import SF, edges, rows

from slabworks.llm import license_scan as m


def plain(text):
    """Every place of every key phrase."""
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)

    def places(phrase):
        p = phrase.split()
        return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]

    base = [(label, i) for label, phrase in m.BASE for i in places(phrase)]
    labels = {label for label, _ in base}
    more = labels | {label for label, _, key in m.TEMPLATES if places(key)}
    at = [i for _, i in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(more))


def agreed(docs, looked_up=m.LOOKED_UP):
    """Of each text the labels that the method adds: every template at every start, word by word."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in docs]
    templates = m.collection()
    vocabulary = sorted({w for t in templates for w in t["words"]} - set(m.STOP))
    idf = {w: math.log((len(docs) + 1) / (sum(w in x for x in map(set, split)) + 1)) + 1 for w in vocabulary}
    rank = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (-idf[w], w)))}
    out = []
    for w in split:
        best = set(sorted({x for x in w if x in rank}, key=rank.get)[:looked_up])
        labels = set()
        for t in (t for t in templates if not t["base"] and len(t["key"]) >= 4):
            for at in range(-len(t["words"]), len(w)):
                here = [w[at + k] if 0 <= at + k < len(w) else None for k in range(len(t["words"]))]
                key = [x == y for x, y in zip(here[t["key_at"] :], t["key"])]
                rarest = min((k for k, x in enumerate(t["key"]) if x in rank), key=lambda k: rank[t["key"][k]])
                if sum(x == y and x in best for x, y in zip(here, t["words"])) >= 2 and key.count(False) == 1:
                    wrong = key.index(False)
                    labels |= {t["label"]} if wrong != rarest and not t["key"][wrong].isdigit() else set()
        out.append(labels)
    return out


def every(docs, looked_up=m.LOOKED_UP):
    """``plain`` of each text, with the labels of ``agreed``."""
    return [(*p[:5], ",".join(sorted({*filter(None, p[5].split(",")), *more}))) for p, more in zip((plain(t) for _, t in docs), agreed(docs, looked_up))]


def test_query_against_every_place(spark):
    found = {r["doc_id"]: tuple(r)[1:] for r in m.op8_license_scan(spark, SF).collect()}
    docs = rows()
    for (i, _), want in zip(docs, every(docs)):
        assert found[i][:6] == want and 0 <= found[i][6] <= 1


NEARLY = [
    (1, "Licensed under the Apache Licence, Version 2.0"),
    (2, "licensed under the gnu general public license version 9"),  # neither 2 nor 3
    (3, "distribution and use in source and binary forms"),
    (4, "subject to the terms of the Xmozilla Public License, v. 2.0"),
    (5, "Permission to use, copy, modify and/or spread this software for any purpose"),  # without its rarest word
    (6, "licence of an apache server version 3 0"),
]


def test_rare_words_that_agree_add_labels(spark):
    df = spark.createDataFrame(NEARLY + [(k, "general software license public version") for k in range(10, 20)], "doc_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    labels = {}
    for looked_up in (0, 1, 3, m.LOOKED_UP):
        found = {r["doc_id"]: tuple(r)[1:7] for r in m.scan(df, looked_up=looked_up).collect()}
        assert [found[i] for i, _ in docs] == every(docs, looked_up)
        labels[looked_up] = {i: x[5] for i, x in found.items() if i < 10}
    assert labels[m.LOOKED_UP] == {1: "apache-2.0", 2: "gpl", 3: "", 4: "", 5: "", 6: ""}
    assert labels[0] == labels[1] == {1: "", 2: "gpl", 3: "", 4: "", 5: "", 6: ""}


def test_no_python_on_the_executors(spark):
    plan = m.op8_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


TEXTS = [
    (40, "CC BY, cc-by and CC  BY-NC 4.0; ccby; c c by cc bystander"),
    (41, " ".join([t for _, t, _ in m.TEMPLATES] * 3)),
    (42, "general public all rights license reserved mit"),
    (43, "All rights reserved. " * 2000 + "GNU General Public License, version 3 " * 3),
    (44, "mit license"),
    (45, "Übung cc by 4,0\u00a0cc by"),
]


def test_planted_texts_and_edges(spark):
    df = edges(spark, TEXTS)
    want = {}
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    for (i, _), x in zip(docs, every(docs)):
        want.setdefault(i, []).append(x)
    found = {}
    for r in m.scan(df).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:7])
        assert len(r["matches"]) >= r["n_base"]
    assert {k: sorted(map(str, v)) for k, v in found.items()} == {k: sorted(map(str, v)) for k, v in want.items()}
    assert m.scan(df.limit(0)).count() == 0


def test_rank_follows_the_files(spark):
    df = spark.createDataFrame([(k, "license") for k in range(5)] + [(9, "warranty")], "doc_id long, text string")
    total, df_ = m.document_frequency(df.select(m.words(df["text"]).alias("words")), ["license", "reserved"])
    assert total == 6 and df_ == {"license": 5}


def test_words_out_of_place_reject_no_key_phrase(spark):
    rng = random.Random(8)
    common = [(k, "public license software general version v") for k in range(100, 150)]
    # terms and mozilla are looked up, public and license are not, and terms stands elsewhere
    docs = [(0, "affero apache binary boost cc0 charge terms. Mozilla Public License, v. 2.0")]
    templates = [t.split() for _, t, _ in m.TEMPLATES]
    for k in range(1, 80):
        parts = []
        for w in rng.sample(templates, 8):  # whole, split in two, or out of order
            cut = rng.randrange(len(w))
            parts += rng.choice([[w], [w[:cut], w[cut:]], [rng.sample(w, len(w))]])
        rng.shuffle(parts)
        docs.append((k, " ".join(w for p in parts for w in p)))
    df = spark.createDataFrame(docs + common, "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:7] for r in m.scan(df).collect()}
    assert "mpl-2.0" in found[0][5]
    assert found == dict(zip((i for i, _ in docs + common), every(docs + common)))


def test_long_texts_of_licence_words_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "gnu public license " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert m.scan(df).first()["n_words"] == 3 * n
        return time.perf_counter() - began

    seconds(10)
    assert seconds(70_000) < 30  # 210,000 words
    text = "all rights reserved gnu general public license " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(m.scan(df).first())[1:7] == plain(text)
