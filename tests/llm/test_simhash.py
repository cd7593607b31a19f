import random
import re

import numpy as np
import xxhash
from tables import SF, edges, rows

from slabworks.llm import simhash as m


def plain(text):
    """Fingerprint by the definition, bit by bit."""
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps, ids, distance=3):
    """The smallest id that each reaches, by comparing all pairs."""
    a, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= distance):
            x, y = find(k), find(int(j))
            root[x] = y
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(a))]


def test_query_against_all_pairs(spark):
    docs = sorted(rows())
    fps = [plain(t) for _, t in docs]
    want = dict(zip((i for i, _ in docs), zip((f"{f:016x}" for f in fps), reach(fps, [i for i, _ in docs]))))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in m.op4_simhash(spark, SF).collect()}
    assert got == want


def test_planted_chains_and_crowds(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):  # chains, each step within reach
        f = rng.getrandbits(64)
        for _ in range(40):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.add(f)
    core = rng.getrandbits(64)  # a crowd around one value
    fps |= {core ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(700)}
    for gap in (3, 4):  # at the limit and past it
        f = rng.getrandbits(64)
        fps |= {f, f ^ sum(1 << b for b in rng.sample(range(64), gap))}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    signed = [r["fp"] for r in df.collect()]
    found = {r["node"]: r["root"] for r in m.components(m.links(df)).collect()}
    ours = {}
    for f, s in zip(fps, signed):
        ours.setdefault(found.get(s, s), set()).add(f)
    theirs = {}
    for f, r in zip(fps, reach(fps, fps)):
        theirs.setdefault(r, set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_large_keys_are_split_again():
    rng = random.Random(3)
    free = (1 << 30) - 1
    fps = np.array(sorted({rng.getrandbits(30) & ~0xFF00 for _ in range(6000)}), np.uint64)

    def parts(edges):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return sorted(sorted(v) for v in _groups({f: find(f) for f in root}).values())

    assert parts(m._pairs(fps, 3, free)) == parts(m._forest(fps, 3))


def _groups(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, []).append(k)
    return out


def test_edges(spark):
    df = edges(spark)
    found = {}
    for r in m.near_duplicates(df).collect():
        found.setdefault(r["doc_id"], []).append((r["component_id"], r["component_size"]))
    assert found[3] == [(3, 4)] * 2 and found[5] == [(3, 4)] and found[7] == found[8] == [(7, 3)]
    assert sorted(found[None], key=str) == [(3, 4), (7, 3), (None, 2), (None, 2)]
    kept = m.keep_first(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "7", "None", "9", "10", "11"])
    assert m.near_duplicates(df.limit(0)).count() == 0 and m.keep_first(df.limit(0)).count() == 0
