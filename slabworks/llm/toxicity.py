"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are indicators of its words, the beginnings of its words, its pairs of
neighbouring words, and its pairs with one or two words between, hashed to a table of
fixed size. FTRL-proximal keeps two sums for each coordinate; their own learning rates
let rare features learn fast, and the L1 part leaves all others at exactly zero, so
the weights that are sent to the tasks are a short list.

Labels are joined to ids alone; texts are read again only for the rows of the fit,
which are a bounded number, and never moved for their labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, scratch, table, texts, with_id

BITS = 22
SIZE = 1 << BITS
STEM = 5  # bytes of a word's beginning
SKIPS = (2, 3)  # distances of the words of a skip-gram
ROWS_PER_CLASS = 4000
FIT_FEATURES = 24_000_000  # features of all texts of the fit
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 5.0, 1.0, 5
BLOCK = 1 << 20  # bytes of words that are hashed at once
_FACTOR = 0x9E3779B97F4A7C15
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, modulo 2**64."""
    inverse = pow(_FACTOR, -1, 1 << 64)
    out = []
    for base in (_FACTOR, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_UP, _DOWN = _powers(BLOCK)


def mix(x: np.ndarray, kind: int) -> np.ndarray:
    """Places in the table of hashes of one kind."""
    x = x + np.uint64(kind * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the ASCII-lower-cased text, and of its first ``STEM`` bytes.

    Words are runs of letters, digits and non-ASCII bytes. A hash is a polynomial of
    the word's bytes, taken from a running sum over a block of words.
    """
    b = np.frombuffer(raw.lower(), np.uint8)
    on = np.zeros(len(b) + 2, np.int8)
    on[1:-1] = _WORD[b]
    edge = np.diff(on)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    whole, stem = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        z = int(np.searchsorted(ends, starts[a] + BLOCK, "right"))
        if z <= a:  # one word longer than a block: the hashes of its pieces together
            h = 0
            for at in range(starts[a], ends[a], BLOCK):
                piece = b[at : min(at + BLOCK, ends[a])]
                h = (h * _FACTOR + int(((piece.astype(np.uint64) + np.uint64(1)) * _UP[: len(piece)]).sum())) & (1 << 64) - 1
            whole[a] = h
            stem[a] = ((b[starts[a] : starts[a] + STEM].astype(np.uint64) + np.uint64(1)) * _UP[:STEM]).sum()
            a += 1
            continue
        first, last = starts[a], ends[z - 1]
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((b[first:last].astype(np.uint64) + np.uint64(1)) * _UP[: last - first], out=sums[1:])
        low, high = starts[a:z] - first, ends[a:z] - first
        whole[a:z] = (sums[high] - sums[low]) * _DOWN[low]
        stem[a:z] = (sums[np.minimum(high, low + STEM)] - sums[low]) * _DOWN[low]
        a = z
    return whole, stem


def places(raw: bytes) -> np.ndarray:
    """Places of a whole text's features, repeats included."""
    w, stem = word_hashes(raw)
    pair = w * np.uint64(0x2545F4914F6CDD1D)
    pairs = [mix(pair[:-d] + w[d:], 2 + d) for d in (1, *SKIPS) if len(w) > d]
    return np.concatenate([mix(w, 1), mix(stem, 2), *pairs]) if len(w) else np.zeros(0, np.int32)


def features(raw: bytes) -> np.ndarray:
    """Sorted distinct places of a text's features."""
    return np.unique(places(raw))


class Ftrl:
    """FTRL-proximal logistic regression; the bias is a coordinate without L1."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, size: int = SIZE):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the bias is last

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, row: np.ndarray, label: int, weight: float = 1.0) -> None:
        """One step on a text's features."""
        at = np.append(row, len(self.z) - 1)
        w = self.weights(at)
        g = (logistic(w.sum()) - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -35.0), 35.0))))


@dataclass
class Model:
    """The places whose weight isn't zero, their weights, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(SIZE, np.float32)
        out[self.at] = self.weight
        return out


def fit(rows: list[np.ndarray], labels: list[int], share: float, epochs: int = EPOCHS, seed: int = 0) -> Model:
    """A model of rows of features; ``share`` is that of label 1 among all labelled texts, by which either class weighs."""
    n = max(1, len(rows))
    weigh = [(1 - share) * n / max(1, labels.count(0)), share * n / max(1, labels.count(1))]
    learner, rng = Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            learner.learn(rows[k], labels[k], weigh[labels[k]])
    at = np.append(np.flatnonzero(np.abs(learner.z[:-1]) > learner.l1), SIZE)  # no other weight differs from zero
    w = learner.weights(at)
    return Model(at[:-1].astype(np.int32), w[:-1].astype(np.float32), float(w[-1]))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(raw) for raw in texts(b.column(2))]
        packed = pa.array([f.tobytes() for f in found], pa.large_binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed.cast(pa.binary()), pa.array([len(f) for f in found], pa.int64())], ["label", "h", "places", "n"])


def in_fit(counted: list[tuple[int, int, int]], most: int) -> set[tuple[int, int]]:
    """``label, h`` of the rows to fit, of ``label, h, n``: classes in turn, lowest hashes first, while all features are ``most`` or fewer."""
    turn, ranked = {}, []
    for h, label, n in sorted((h, label, n) for label, h, n in counted):
        turn[label] = turn.get(label, -1) + 1
        ranked.append((turn[label], label, h, n))
    out, size = set(), 0
    for _, label, h, n in sorted(ranked):
        size += n
        if size > most:
            break
        out.add((label, h))
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = ROWS_PER_CLASS, most: int = FIT_FEATURES) -> Model | None:
    """A model of ``label`` (0 or 1); None without labelled texts.

    The fit takes one text of each id (that with the lowest hash), ``per_class`` ids of
    each class and ``most`` features in all at most, those whose ids hash lowest; the
    classes' shares are counted over all labelled ids. An id with several labels has the
    largest; rows without an id or a label teach nothing.
    """
    with scratch(docs.sparkSession) as save:
        known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
        own = docs.select(F.col(id_col).alias("of")).where("of IS NOT NULL").distinct()
        ids = save(known.join(own, F.col("id") == F.col("of"), "left_semi").withColumn("h", F.xxhash64("id")), "labelled-ids")
        counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
        if not counts:
            return None
        low, high = (ids.where(F.col("label") == c).orderBy("h", "id").limit(per_class) for c in (0, 1))
        chosen = low.unionByName(high).select(F.col("id").alias("of"), "label", "h")  # 2 * per_class ids at most
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("of"))
        one = rows.groupBy("label", "h", "id").agg(F.min(F.struct(F.xxhash64("text").alias("t"), F.col("text"))).alias("first"))
        found = save(one.select("label", "h", F.col("first.text").alias("text")).mapInArrow(_feature_rows, "label int, h long, places binary, n long"), "fit")
        kept = in_fit([(r["label"], r["h"], r["n"]) for r in found.select("label", "h", "n").collect()], most)
        last = {c: max((h for x, h in kept if x == c), default=None) for c in (0, 1)}
        inside = [(F.col("label") == c) & (F.col("h") <= h) for c, h in last.items() if h is not None]
        fitted = found.where(inside[0] | inside[-1]).orderBy("h", "label").collect() if inside else []
    return fit([np.frombuffer(r["places"], np.int32) for r in fitted], [r["label"] for r in fitted], counts.get(1, 0) / sum(counts.values()))


def _score_rows(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.dense() if model else None
        for b in batches:
            out = []
            for raw in texts(b.column(1)):
                if model is None:
                    out.append(0.0)
                    continue
                at = places(raw)
                at = np.unique(at[w[at] != 0])  # most weights are zero
                out.append(logistic(float(w[at].sum(dtype=np.float64)) + model.bias))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, score`` (0 to 1, higher: label 1 likelier) of every whole text.

    Null and empty texts are scored by the bias alone; without a model every score is
    0. Ids may be null or repeat; other columns aren't read; no rows give no rows. Texts
    that agree have the same score; a text's memory is some 40 times its length.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_score_rows(model), with_id(docs, id_col, "score double")).withColumnRenamed("id", id_col)


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out), labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
