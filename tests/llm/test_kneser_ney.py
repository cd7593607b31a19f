import collections
import math
import random
import zlib

import numpy as np
import pytest
from tables import SF, edges, rows

from slabworks.llm import kneser_ney as m


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts):
        texts = [tokens(t) for t in texts]
        self.c = collections.Counter(w for t in texts for w in t)
        self.two = collections.Counter(p for t in texts for p in zip([None, *t], t))
        self.of, self.before, self.n = collections.Counter(), collections.Counter(b for _, b in self.two), collections.defaultdict(lambda: [0, 0, 0])
        for (a, _), k in self.two.items():
            self.of[a] += k
            self.n[a][min(k, 3) - 1] += 1
        self.d2, self.d1 = (m.discounts([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]) for x in (self.two, self.before))
        self.total, self.size = sum(self.c.values()), len(self.c)
        kinds = collections.Counter(min(v, 3) for v in self.before.values())
        self.rest = sum(d * kinds[k] for k, d in enumerate(self.d1, 1)) / max(1, len(self.two))

    def one(self, w):
        k = self.before[w]
        return max(k - (self.d1[min(k, 3) - 1] if k else 0), 0) / len(self.two) + self.rest / (self.size + 1)

    def p(self, a, w):
        if not self.of[a]:
            return self.one(w)
        k = self.two[(a, w)]
        return (max(k - (self.d2[min(k, 3) - 1] if k else 0), 0) + sum(d * n for d, n in zip(self.d2, self.n[a])) * self.one(w)) / self.of[a]

    def scores(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c[w] + 1) / (self.total + self.size + 1)) for w in t)
        return len(t), sum(self.c[w] > 0 for w in t), self.total, base, sum(math.log10(self.p(a, w)) for a, w in zip([None, *t], t))


def test_probabilities_add_up():
    plain = Plain(["a b a c", "b a b", None, "c"])
    for context in (None, b"a", b"b", b"zz"):
        assert sum(plain.p(context, w) for w in [*plain.c, b"unseen"]) == pytest.approx(1)


@pytest.mark.parametrize("size", [1 << 20, 6000])
def test_order_2_against_dictionaries(spark, size):
    docs = spark.createDataFrame(rows()[:60], "doc_id long, text string").repartition(5)
    plain = Plain(t for _, t in rows()[:60])
    model = m.train(docs, bucket_bytes=size, order=2)
    assert (model.n_tokens, model.n_words, model.levels[0].n) == (plain.total, plain.size, len(plain.two))
    assert model.levels[0].d == pytest.approx(plain.d2) and model.d1 == pytest.approx(plain.d1)
    for r in m.score(docs, model).collect():
        t = dict(rows()[:60])[r["doc_id"]]
        assert r["score"] == pytest.approx(plain.scores(t)[4], rel=1e-9) and r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_array_helpers():
    rng = np.random.default_rng(1)
    for size, top in ((1, 1), (5, 2**63), (300, 70_000), (300, 3)):
        head, rest = np.sort(rng.integers(0, 2**64, size, dtype=np.uint64)), rng.integers(0, top, size)
        got = m.unpacked(m.packed(head, rest, rest + 1))
        assert [x.tolist() for x in got] == [head.tolist(), rest.tolist(), (rest + 1).tolist()]
    k, c = m.summed(np.array([3, 1, 3], np.uint64), np.array([5, 1, 2]))
    assert k.tolist() == [1, 3] and c.tolist() == [1, 7]
    for top in (5, 2**40):  # pairs of 64 bits and of more
        c, s = rng.integers(0, top, 400), rng.integers(0, 5, 400) * (top // 5)
        want = collections.Counter(zip(c.tolist(), s.tolist()))
        got = m.summed_pairs(c, s)
        assert {(a, b): n for a, b, n in zip(*(x.tolist() for x in got))} == want and list(zip(got[0], got[1])) == sorted(want)
    a = np.array([1, 4, 9, 2, 3, 3 + 4])
    assert m.bisect(a, np.array([0, 0, 3, 3, 6]), np.array([3, 3, 6, 3, 6]), np.array([4, 5, 7, 2, 1])).tolist() == [1, -1, 5, -1, -1]


def test_counts_of_any_size_come_back(tmp_path):
    counts = np.array([1, 254, 255, 256, 2**40, 0])
    files = m.Files(str(tmp_path))
    files.write_counts("x", 3, counts)
    assert m.Files(str(tmp_path)).counts("x", 3, np.arange(6)).tolist() == counts.tolist()


def test_few_files_stay_mapped(tmp_path, monkeypatch):
    monkeypatch.setattr(m, "OPEN_FILES", 3)
    files = m.Files(str(tmp_path))
    for k in range(10):
        files.write("x", k, np.array([k]))
    assert [int(files("x", k % 10)[0]) for k in range(25)] == [k % 10 for k in range(25)] and len(files.files) == 3


def test_cuts_of_contexts():
    places, shares = m.next_cuts(np.array([3, 3, 3, 40, 3]), 10)
    assert list(zip(places.tolist(), shares.round(3).tolist())) == [(0, 0), (3, 0.025), (3, 0.275), (3, 0.525), (3, 0.775), (4, 0)]
    assert [x.tolist() for x in m.next_cuts(np.zeros(0, np.int64), 10)] == [[0], [0]]


class Plain3(Plain):
    """The model of order 3 by dictionaries; a context has two words, before a text both are empty."""

    def __init__(self, texts):
        super().__init__(texts)
        self.three = collections.Counter(x for t in map(tokens, texts) for x in zip([None, None, *t], [None, *t], t))
        self.left = collections.Counter((b, c) for _, b, c in self.three)
        self.of2, self.of3 = collections.Counter(), collections.Counter()
        self.n2, self.n3 = (collections.defaultdict(lambda: [0, 0, 0]) for _ in range(2))
        for (a, _), k in self.left.items():
            self.of2[a] += k
            self.n2[a][min(k, 3) - 1] += 1
        for (a, b, _), k in self.three.items():
            self.of3[a, b] += k
            self.n3[a, b][min(k, 3) - 1] += 1
        self.d2, self.d3 = (m.discounts([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]) for x in (self.left, self.three))

    def two_words(self, a, w):
        k = self.left[a, w]
        return (max(k - (self.d2[min(k, 3) - 1] if k else 0), 0) + sum(d * n for d, n in zip(self.d2, self.n2[a])) * self.one(w)) / self.of2[a] if self.of2[a] else self.one(w)

    def p3(self, a, b, w):
        if not self.of3[a, b]:
            return self.two_words(b, w)
        k = self.three[a, b, w]
        return (max(k - (self.d3[min(k, 3) - 1] if k else 0), 0) + sum(d * n for d, n in zip(self.d3, self.n3[a, b])) * self.two_words(b, w)) / self.of3[a, b]

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p3(*x)) for x in zip([None, None, *t], [None, *t], t))


@pytest.mark.parametrize("size", [1 << 20, 6000])
def test_order_3_against_dictionaries(spark, size):
    texts = rows()
    plain = Plain3([t for _, t in texts[:60]])
    model = m.train(spark.createDataFrame(texts[:60], "doc_id long, text string").repartition(5), bucket_bytes=size)
    assert model.order == 3 and model.levels[1].n == len(plain.three) and model.levels[1].d == pytest.approx(plain.d3) and model.levels[0].d == pytest.approx(plain.d2)
    docs = spark.createDataFrame(texts[:90], "doc_id long, text string")  # some are held out
    for r in m.score(docs, model).collect():
        assert r["score"] == pytest.approx(plain.score(dict(texts)[r["doc_id"]]), rel=1e-9)


def test_contexts_that_are_cut(spark):
    """One word stands in every second place and texts begin alike, so that contexts of every length go over many buckets."""
    rng = random.Random(6)
    docs = [(k, " ".join(f"the w{rng.randrange(60)} the x{rng.randrange(3)}" for _ in range(rng.randrange(12)))) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    plain = Plain3([t for _, t in docs[:150]])
    model = m.train(df.where("doc_id < 150"), bucket_bytes=300)
    assert [len(level.shared) > 0 and len(level.contexts) > 10 for level in model.levels] == [True, True]
    assert [level.n for level in model.levels] == [len(plain.two), len(plain.three)]
    for r in m.score(df, model).collect():
        assert r["score"] == pytest.approx(plain.score(dict(docs)[r["doc_id"]]), rel=1e-9)


def test_query_against_dictionaries(spark):
    docs = rows()
    plain = Plain3([t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2])
    found = {r["doc_id"]: r for r in m.op6_lm_score(spark, SF).collect()}
    assert set(found) == {i for i, _ in docs}
    for i, t in docs:
        assert tuple(found[i])[2:6] == pytest.approx(plain.scores(t)[:4], rel=1e-9) and found[i]["score"] == pytest.approx(plain.score(t), rel=1e-9)
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_order_4_adds_up(spark):
    """Of all words and an unseen one, after seen and unseen contexts."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a b a c a", "b a b a c", None, "c a b a b"])], "doc_id long, text string")
    model = m.train(df, order=4)
    assert model.order == 4
    for context in ("", "a", "a b", "b a b", "a b a", "zz a b", "c zz a", "a b a c a b"):
        # a text's score less that of its context: its last word and its end
        whole = {w: f"{context} {w}".strip() for w in ("a", "b", "c", "zz")}
        found = {r["doc_id"]: r["score"] for r in m.score(spark.createDataFrame([*whole.items(), ("", context)], "doc_id string, text string"), model).collect()}
        files, = [m.Files(model.folder)]
        assert all(v < 0 for v in found.values())
        ends = {w: next_end(model, files, t) for w, t in whole.items()}
        last = sum(10 ** (found[w] - ends[w] - (found[""] - next_end(model, files, context))) for w in whole)
        assert last + 10 ** next_end(model, files, context) == pytest.approx(1)


def test_files_beyond_the_limit_leave_others_mapped(tmp_path, monkeypatch):
    opened = collections.Counter()
    monkeypatch.setattr(m, "_mapped", lambda path, f=m._mapped: opened.update([path]) or f(path))
    monkeypatch.setattr(m, "OPEN_FILES", 8)
    files = m.Files(str(tmp_path))
    for k in range(10):
        files.write("x", k, np.array([k]), np.array([-k]))
    assert [files.all("x", k % 10)[1].tolist() for k in range(50)] == [[-(k % 10)] for k in range(50)]
    assert len(files.files) == 8 and sum(opened.values()) <= 10 + 4 * 3  # all of 50 when the oldest makes way


@pytest.mark.parametrize("kind", ["string", "binary", "large_string"])
def test_tokens_of_odd_texts_and_over_batches(monkeypatch, kind):
    """White space of all kinds and at both ends, bytes that aren't UTF-8, slices that end within a batch and go over batches."""
    import pyarrow as pa

    texts = [None, "", " \n", "  A b\t\tC ", "a\x0bb\x0cc\x1cd\x85e \u00c9A\u2003z", b"\xff B \xc3", "x " * 50, "a"] * 3
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    batches = [pa.array(raw[a:b], pa.binary()) for a, b in ((0, 9), (9, 9), (9, 10), (10, len(raw)))]
    batches = [x if kind == "binary" else x.view(pa.string()) if kind == "string" else x.cast(pa.large_binary()).view(pa.large_string()) for x in batches]
    want = [[m.xxhash.xxh64_intdigest(w) for w in [*(t or b"").lower().split(), b"\n"]] for t in raw]
    for size in (1, 7, 60, 1 << 20):
        monkeypatch.setattr(m, "SLICE_TOKENS", size)
        found = [x.tolist() for h, ends in m.token_hashes(iter(batches)) for x in np.split(h, ends[:-1])]
        assert found == want


def test_files_and_parts_by_size_of_buckets(spark, monkeypatch):
    """Buckets are as many as the occurrences need, whatever the buckets below; a file is mapped once for all tasks of a process."""
    import pyarrow as pa

    texts = rows()[:120]
    plain = Plain3([t for _, t in texts])
    most = 1500
    model = m.train(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), bucket_bytes=most * m.BYTES_PER_TOKEN)
    need = model.n_tokens / most
    assert need > 10 and all(len(level.contexts) <= 2 * need + 2 for level in model.levels)
    assert len(m._groups([1] * 4096, 64)) == 64 and m._groups([100, 1, 1, 100, 3], 5).tolist() == [0, 1, 3, 4]
    cuts = [(10 * k, np.array([0]), np.array([0.0]), np.array([0, 30])) for k in range(9)]
    assert [base for base, places, _ in m._fewer(cuts, 100) for _ in places] == [30, 60]
    opened = collections.Counter()
    monkeypatch.setattr(m, "_mapped", lambda path, f=m._mapped: opened.update([path]) or f(path))
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["id", "text"]) for i, t in texts]
    for _ in range(3):  # tasks of one worker
        got = dict(zip(*(x for b in m._score_rows(model)(iter(batches)) for x in (b.column("id").to_pylist(), b.column("score").to_pylist()))))
        assert got == {i: pytest.approx(plain.score(t), rel=1e-9) for i, t in texts}
    assert set(opened.values()) == {1} and len(opened) <= 3 * 2**model.bits + 2 * sum(len(level.contexts) for level in model.levels)


def next_end(model, files, text):
    """log10 of the probability of a text's end, from scores of the tokens one by one."""
    import pyarrow as pa

    def total(tokens):
        h = np.array([m.xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
        run = m._score_rows(model)
        cells = dict(zip(run.__code__.co_freevars, (c.cell_contents for c in run.__closure__)))
        return float(cells["scores"](files, h, np.array([len(h)]))[3][0]) if len(h) else 0.0

    tokens = [*text.encode().split(), b"\n"]
    return total(tokens) - total(tokens[:-1])


def test_order_3_adds_up_and_has_edges(spark):
    plain = Plain3(["a b a c", "b a b", None, "c"])
    for context in ((None, None), (None, b"a"), (b"a", b"b"), (b"zz", b"b"), (b"b", b"zz")):
        assert sum(plain.p3(*context, w) for w in [*plain.c, b"unseen"]) == pytest.approx(1)
    df = edges(spark)
    plain = Plain3([r["text"] for r in df.collect()])
    assert sorted(r["score"] for r in m.score(df, m.train(df)).collect()) == pytest.approx(sorted(plain.score(r["text"]) for r in df.collect()))
    none = m.score(df, m.train(df.limit(0))).collect()
    assert {(r["train_tokens"], r["base_score"], r["score"], r["n_known"]) for r in none} == {(0, 0.0, 0.0, 0)}
    assert m.score(df.limit(0), m.train(df)).count() == 0
    with pytest.raises(ValueError):
        m.train(df, order=1)
