import random

import corpus_pipeline
import numpy as np
from tables import SF, edges, rows
from test_jaccard import reach

from slabworks.llm import jaccard
from slabworks.llm import wide_simhash as m


def components(df, **kw):
    return {r["doc_id"]: r["component_id"] for r in m.near_duplicates(df, **kw).collect()}


def test_the_stage_links_by_simhash(spark, monkeypatch):
    """The pipeline's stage goes by fingerprints, blocks and distances: without a distance it links short sets only."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = reach(rows())
    assert components(docs) == want
    monkeypatch.setattr(jaccard, "near_duplicates", None)  # another method isn't asked
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert kept() == sorted(i for i, r in want.items() if i == r)
    monkeypatch.setattr(m, "FAR", -1)
    assert len(kept()) > len(set(want.values()))


def test_planted_copies_chains_and_crowds(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    line = " ".join(word() for _ in range(12))  # stands in many texts
    docs = []
    for size in (3, 5, 6, 8, 9, 12, 14, 20, 24, 26, 30, 40, 200, 3000):
        for changes in (0, 1, 2, 3, 5):
            text = [word() for _ in range(size)]
            docs.append(text)
            for _ in range(3):  # a chain: each is a changed copy of the one before
                text = list(text)
                for _ in range(changes):
                    text[rng.randrange(size)] = word()
                docs.append(text)
            docs += [text + [word() for _ in range(size // 5)], text[: -max(1, size // 6)]]
    crowd = [word() for _ in range(150)]
    docs += [[word() if rng.random() < 0.015 else w for w in crowd] for _ in range(150)]
    docs += [[word() for _ in range(rng.randrange(10, 60))] + [line] for _ in range(150)]
    docs = list(enumerate(map(" ".join, docs)))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = reach(docs)
    assert components(df) == want
    assert 200 < len(set(want.values())) < len(docs) - 150
    for crowd in (1, 20):  # keys of more sets meet on rare shingles
        assert components(df, crowd=crowd) == want


def test_pairs_at_the_border_are_found():
    """Of pairs whose similarity is just 0.8, all share a key and are within the distance."""
    rng = np.random.default_rng(3)
    for size in (20, 40, 400):
        for a, b in ((size // 8, size // 8), (size // 4, 0), (size // 16, size // 4 - size // 16)):
            if 5 * size < 4 * (size + a + b):
                continue
            for _ in range(60):
                h = rng.integers(0, 1 << 63, size + a + b, np.uint64)
                one, two = (m.fingerprint(np.sort(x)) for x in (h[: size + a], np.append(h[:size], h[size + a :])))
                assert (m.keys(one[None]) == m.keys(two[None])).any()
                assert np.bitwise_count(one[:32] ^ two[:32]).sum() <= m.FAR


def test_short_sets_share_a_first_shingle():
    """Similar sets of up to 20 do, however they differ; sets of under four shingles are similar to equal ones only."""
    rng = np.random.default_rng(8)
    for _ in range(3000):
        common, a = rng.integers(3, 21), rng.integers(0, 4)
        b = rng.integers(0, 5)
        h = rng.integers(0, 1 << 63, common + a + b, np.uint64)
        one, two = np.sort(h[: common + a]), np.sort(np.append(h[:common], h[common + a :]))
        if a + b and max(len(one), len(two)) <= 20 and 5 * common >= 4 * len(h):
            assert set(m.first(one, 20).tolist()) & set(m.first(two, 20).tolist())
    assert [len(m.first(np.arange(n, dtype=np.uint64), 20)) for n in (1, 3, 4, 5, 6, 9, 10, 20, 21)] == [0, 0, 1, 2, 2, 2, 3, 5, 0]


def test_fingerprints_by_the_definition():
    h = np.random.default_rng(4).integers(0, 1 << 63, 600, np.uint64)
    for n in (1, 2, 255, 256, 600):
        bits = np.stack([np.unpackbits(m.mix(x ^ m._SALTS).view(np.uint8)) for x in h[:n]]).astype(int)
        want = np.where(2 * bits.sum(axis=0) == n, bits[0], 2 * bits.sum(axis=0) > n)
        assert (np.unpackbits(m.fingerprint(h[:n])) == want).all()


def test_keys_go_on_over_batches(tmp_path, monkeypatch):
    """Mates of a key are found wherever batches end; a crowded key's rows all go on."""
    rng = np.random.default_rng(6)
    n = 400
    prints = rng.integers(0, 1 << 63, (n, m.PRINT + 1), np.uint64)
    prints[:, m.PRINT] = np.arange(n) * 10
    for k in range(0, n, 7):
        prints[k, : m.PRINT] = prints[(k * 3 + 1) % n, : m.PRINT] ^ np.uint64(1)
    (tmp_path / "0.prints").write_bytes(prints.tobytes())
    rows = sorted((int(k), int(s)) for s in range(n) for k in (rng.integers(0, 60), 100 + (s < 90), 200 + s, -1 - s // 2))
    by = {}
    for k, s in rows:
        by.setdefault(k, []).append(s)
    near = lambda s, t: s != t and np.bitwise_count(prints[s, : m.PRINT] ^ prints[t, : m.PRINT]).sum() <= m.FAR
    want = sorted((k, 10 * s) for k, ss in by.items() for s in ss if k < 0 or len(ss) > 50 or any(near(s, t) for t in ss))
    for size, held in ((1, 1), (7, 16), (50, 200), (5000, 1 << 16)):
        monkeypatch.setattr(m, "ROWS", held)
        parts = [rows[a : a + size] for a in range(0, len(rows), size)]
        batches = (m.pa.RecordBatch.from_arrays([m.pa.array([k for k, _ in p], m.pa.int64()), m.pa.array([s for _, s in p], m.pa.int64())], ["key", "slot"]) for p in parts)
        found = [(x["key"], x["place"]) for b in m._near_rows(str(tmp_path), 50, m.FAR)(batches) for x in b.to_pylist()]
        assert found == want, (size, held)


def test_edges(spark):
    df = edges(spark)
    found = {}
    for r in m.near_duplicates(df).collect():
        found.setdefault(r["doc_id"], []).append((r["component_id"], r["component_size"]))
    assert found[3] == [(3, 4)] * 2 and found[5] == [(3, 4)] and found[7] == found[8] == [(7, 3)]
    kept = m.keep_first(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "7", "None", "9", "10", "11"])
    assert m.near_duplicates(df.limit(0)).count() == 0 and m.keep_first(df.limit(0)).count() == 0
