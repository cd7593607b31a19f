import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from tables import SF, edges, rows

from slabworks.llm import decontaminate as m


def fewest(item, text):
    """Edits of the item against the nearest stretch of the text, by the whole table over characters."""
    row, places, points = np.zeros(len(text) + 1, int), np.arange(len(text) + 1), np.array([*map(ord, text)], int)
    for i, c in enumerate(item, 1):
        best = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (points != ord(c))))
        row = np.minimum.accumulate(best - places) + places
    return int(row.min())


def edited(rng, item, edits, letters="abcxyz "):
    p = list(item)
    for _ in range(edits):
        x, kind = rng.randrange(len(p)), rng.random()
        if kind < 0.33:
            p[x] = rng.choice(letters)
        elif kind < 0.66:
            del p[x]
        else:
            p.insert(x, rng.choice(letters))
    return "".join(p)


def index_of(items):
    return m.Index.of(pa.array([i for i, _ in items]), [t for _, t in items])


def find(index, text):
    g = m.grams(m.points(text))
    return index.find(text, np.arange(len(g), dtype=np.uint32), g)


def test_index_against_whole_tables(monkeypatch):
    items = [(i, m.normalise(t.encode())) for i, t in rows("benchmark", "item_id, text")]
    texts = [m.normalise(t.encode()) for _, t in rows()]
    index, rng = index_of(items), random.Random(11)
    for turn in range(150):
        monkeypatch.setattr(m, "PAIRS", 0 if turn % 2 else 1 << 20)  # counting item by item, and all at once
        k = rng.randrange(len(items))
        base, allowed = rng.choice(texts)[:2000], int(index.edits[k])
        at = rng.randrange(len(base) + 1)
        text = base[:at] + edited(rng, items[k][1], rng.randint(0, allowed + 4)) + base[at:]
        found = {x[0]: x for x in find(index, text)}
        want = fewest(items[k][1], text)
        assert (found[k][1] == want) if want <= allowed else k not in found
        if k in found:
            assert fewest(items[k][1], text[found[k][2] : found[k][3]]) <= want


@pytest.mark.parametrize("pairs", [0, 1 << 20])
def test_repetitive_texts_against_whole_tables(monkeypatch, pairs):
    """One or two letters, so that every q-gram stands in many places; regions are aligned in pieces."""
    monkeypatch.setattr(m, "PAIRS", pairs)
    monkeypatch.setattr(m, "DIAGONALS", 64)
    rng = random.Random(7)
    for _ in range(60):
        items = [(k, "".join(rng.choices("ab", [rng.choice([0, 0.02, 0.5]), 1], k=rng.randint(12, 200)))) for k in range(4)]
        text = "".join(rng.choices("ab", [rng.choice([0, 0.02, 0.5]), 1], k=rng.randint(1, 700)))
        index = index_of(items)
        found = {x[0]: x[1] for x in find(index, text)}
        assert found == {k: n for k, t in items if (n := fewest(t, text)) <= index.edits[k]}


def test_passages_of_other_scripts_count_by_characters(spark):
    rng = random.Random(3)
    script = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    item = "".join(rng.choices(script, k=100))
    changed = list(item)
    for k in rng.sample(range(100), 5):  # five of a hundred characters replaced
        changed[k] = rng.choice(script)
    other = "".join(rng.choices(script, k=300))
    docs = spark.createDataFrame([(1, other + "".join(changed) + other), (2, other)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    (a, b) = sorted(m.find_contamination(docs, bench).collect())
    assert a["items"] == [7] and a["edits"] == [sum(x != y for x, y in zip(item, changed))] and (a["starts"], a["ends"]) == ([300], [400]) and b["items"] == []


def test_long_repeated_text_takes_bounded_memory(tmp_path):
    """1 MB of one letter against passages of the same letter, one of them as long, one with two edits, in another process."""
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from slabworks.llm import decontaminate as m
n = 1_000_000
items = ["a" * 1000, "a" * n, "a" * 500 + "bb" + "a" * 500]
m.Index.of(pa.array([1, 2, 3]), items).save(sys.argv[1] + "/one")
g = np.unique(np.concatenate([m.grams(m.points(t)) for t in items]))
marks = np.zeros(1 << 13, np.uint8)
bit = (g >> np.uint64(48)).astype(np.int64)
np.bitwise_or.at(marks, bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
np.save(sys.argv[1] + "/marks.npy", marks)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = m.Benchmark(sys.argv[1], ["one"]).find("a" * n)
print([x[:2] for x in found], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) / 1000)
"""
    root = m.__file__.rpartition("/slabworks/")[0]
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}).stdout
    found, peak = out.rsplit(" ", 1)
    assert found == "[(1, 0), (3, 2), (2, 0)]" and float(peak) < 1000, out


def test_query_against_every_item_and_document(spark):
    items = [(i, m.normalise(t.encode())) for i, t in rows("benchmark", "item_id, text")]
    found = {r["doc_id"]: r for r in m.op3_decontaminate(spark, SF).collect()}
    for i, t in rows():
        text = m.normalise((t or "").encode())
        if len(text) < 3000:
            want = [k for k, x in items if fewest(x, text) <= m.budget(len(x))]
            assert sorted(found[i]["item_ids"]) == want and found[i]["contaminated"] == bool(want)
    assert any(r["contaminated"] for r in found.values())


def test_blocks_give_what_one_index_gives(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {r["doc_id"]: sorted(r["items"]) for r in m.find_contamination(docs, bench).collect()}
    monkeypatch.setattr(m, "BLOCK_CHARS", 2000)
    assert len(m.write_index(bench)[1]) > 3
    assert {r["doc_id"]: sorted(r["items"]) for r in m.find_contamination(docs, bench).collect()} == whole


def test_edges(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away from the bear"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, "x y"), (3, ""), (4, "..."), (5, "tiny one")], "item_id long, text string")
    more = [(20, item.upper()), (21, f"x {item.replace(' ', chr(10))}! y"), (22, item[:40]), (23, "a tiny  one."), (24, "tiny ones"), (25, item.replace("lazy", "lzy"))]
    df = edges(spark, more)
    found = {}
    for r in m.find_contamination(df, bench).collect():
        found.setdefault(r["doc_id"], []).append((r["items"], r["edits"]))
    assert found[20] == found[21] == [([1, 1], [0, 0])] and found[22] == found[24] == [([], [])] and found[23] == [([5], [0])] and found[25] == [([1, 1], [1, 1])]
    assert found[3] == [([], [])] * 2 and len(found[None]) == 4
    clean = m.keep_clean(df, bench)
    assert clean.columns == df.columns and clean.count() == df.count() - 4
    assert m.find_contamination(df, bench.limit(0)).where("size(items) > 0").count() == 0 and m.keep_clean(df, bench.limit(0)).count() == df.count()
    assert m.find_contamination(df.limit(0), bench).count() == 0 and m.keep_clean(df.limit(0), bench).count() == 0


def test_gram_values_depend_on_all_their_characters():
    base = "".join(chr(c) for c in range(0x100, 0x100 + m.Q))
    value = lambda t: m.grams(m.points(t)).tolist()
    values = {value(base)[0]} | {value(base[:k] + "z" + base[k + 1 :])[0] for k in range(m.Q)}
    assert len(values) == m.Q + 1 and value("short") == []
    text = "".join(random.Random(1).choices("abc é", k=500))
    assert value(text) == [value(text[k : k + m.Q])[0] for k in range(len(text) - m.Q + 1)]
    assert value("abcdefghijklm") == m.grams(np.array([*map(ord, "abcdefghijklm")], np.uint32)).tolist()


def test_short_passages_are_found_as_words():
    index = index_of([(0, "a b"), (1, "bc"), (2, "a b"), (3, "d e f g")])
    for text in ("a b", "x a b", "aa b", "a bc", "bc a  b".replace("  ", " "), "", "d e f g h", "cd e f g"):
        want = [(k, 0, f" {text} ".find(f" {t} ")) for k, t in enumerate(["a b", "bc", "a b", "d e f g"]) if f" {t} " in f" {text} "]
        assert [x[:3] for x in find(index, text)] == want


def test_many_blocks_in_one_worker(spark, monkeypatch):
    """The workers map 60 blocks; documents get what each block alone would give."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(words, k=40))) for k in range(600)]
    docs = [(k, " ".join(rng.choices(words, k=30)) + " " + (items[k][1] if k % 3 == 0 else "") + " end") for k in range(300)]
    monkeypatch.setattr(m, "BLOCK_CHARS", 2000)
    bench = spark.createDataFrame(items, "item_id long, text string")
    folder, blocks = m.write_index(bench)
    assert len(blocks) > 50
    found = {r["doc_id"]: r["items"] for r in m.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert found == {k: [k] if k % 3 == 0 else [] for k, _ in docs}
