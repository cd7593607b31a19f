"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: of its bytes (n from 1 to 4), of
its runs of character classes (n from 2 to 6), and of how often a word follows itself.
Class log-count ratios come from all labelled texts of the training folds, counted in
Spark. Indicators scaled by these ratios, at unit length, train a linear model with
hinge loss by dual coordinate descent on a bounded sample; a logistic curve fitted on
margins of texts left out of the fit turns margins into scores.

Texts meet their labels in one join, the same at every size, and only texts that
(nearly surely) have a label are moved for it: see ``common.maybe``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, maybe, scratch, texts, with_id

BYTE_BITS, CLASS_BITS, REPEATS = 16, 14, 16
SIZE = (1 << BYTE_BITS) + (1 << CLASS_BITS) + REPEATS + 1
BIAS = SIZE - 1
ROWS_PER_CLASS = 2000
COST, EPOCHS = 1.0, 20
FIT_FEATURES = 16_000_000  # indicators of all texts of the fit
_MULTIPLY = np.uint32(2654435761)
_CLASS = np.array([32 if b in (9, 10, 11, 12, 13, 32) else 97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint32)


def indicators(raw: bytes) -> np.ndarray:
    """Which indicators a whole text has; an empty text has the bias alone."""
    on = np.zeros(SIZE, bool)
    on[BIAS] = True
    b = np.frombuffer(raw, np.uint8)
    if len(b):
        wide = b.astype(np.uint32)
        g = wide
        for n in range(1, min(4, len(b)) + 1):
            if n > 1:
                g = (g[:-1] << np.uint32(8)) | wide[n - 1 :]
            on[((g + np.uint32(n)) * _MULTIPLY) >> np.uint32(32 - BYTE_BITS)] = True
        c = _CLASS[b]
        c = c[np.append(True, c[1:] != c[:-1])]
        g = c
        for n in range(2, min(6, len(c)) + 1):
            g = g[:-1] * np.uint32(131) + c[n - 1 :]
            on[(1 << BYTE_BITS) + (((g + np.uint32(n)) * _MULTIPLY) >> np.uint32(32 - CLASS_BITS))] = True
        words = raw.split()
        same = sum(map(bytes.__eq__, words[1:], words))
        level = 0 if not same else max(1, min(REPEATS - 1, REPEATS - 1 + int(np.floor(np.log2(same / len(words))))))
        on[(1 << BYTE_BITS) + (1 << CLASS_BITS) : (1 << BYTE_BITS) + (1 << CLASS_BITS) + level + 1] = True
    return on


def features(raw: bytes) -> np.ndarray:
    """Sorted indices of a text's indicators."""
    return np.flatnonzero(indicators(raw)).astype(np.int32)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature, how many texts of either class have it: one row a feature and task."""
    counts = np.zeros((2, SIZE), np.int64)
    for batch in batches:
        for raw, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[label][features(raw)] += 1
    at = np.flatnonzero(counts.any(axis=0))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], ["feature", "n0", "n1"])


def log_ratios(labelled: DataFrame) -> np.ndarray:
    """Class log-count ratios over all rows of ``text, label``; the sums are one row a feature."""
    sums = labelled.select("text", "label").mapInArrow(_count_rows, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = np.ones((2, SIZE))
    for r in sums.toLocalIterator():
        n[0][r["feature"]] += r["n0"]
        n[1][r["feature"]] += r["n1"]
    return np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indicators as bits: a row takes ``SIZE / 8`` bytes however long its text is."""
    for batch in batches:
        found = [np.packbits(indicators(raw)).tobytes() for raw in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["h", "bits", "label"])


def in_fit(found: list[tuple[int, bytes, int]], most: int = FIT_FEATURES) -> list[tuple[np.ndarray, int]]:
    """``features, label`` of ``h, bits, label``: classes in turn, lowest hashes first, while all features are ``most`` or fewer; the rows of lowest hash of either class always."""
    turn: dict[int, int] = {}
    ranked = []
    for h, bits, label in sorted(found):
        turn[label] = turn.get(label, -1) + 1
        ranked.append((turn[label], label, h, bits))
    out, size = [], 0
    for k, label, _, bits in sorted(ranked):
        row = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[:SIZE]).astype(np.int32)
        size += len(row)
        if k and size > most:
            break
        out.append((row, label))
    return out


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent (L2 regularisation).

    Each step solves for one multiplier exactly, within 0 and ``cost``; classes weigh alike.
    """
    values = [unit(scale[i]).astype(np.float32) for i in rows]
    w, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    share = {c: len(y) / (2 * max(1, (y == c).sum())) for c in (-1, 1)}
    top = cost * np.array([share[c] for c in y])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            i, x = rows[k], values[k]
            gradient = y[k] * (w[i] @ x) - 1.0
            new = min(max(alpha[k] - gradient, 0.0), top[k])  # the row has unit length
            if new != alpha[k]:
                w[i] += (new - alpha[k]) * y[k] * x
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-3:
            break
    return w


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(x @ x)
    return x / n if n else x


def calibrate(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of margins with the least weighted loss, by Newton steps."""
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        gradient = x.T @ (weight * (p - (y > 0))) + 1e-3 * np.array([a, b])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    weight: np.ndarray
    scale: np.ndarray
    slope: float
    offset: float

    def score(self, raw: bytes) -> float:
        i = features(raw)
        s = self.scale[i]
        n = np.sqrt(s @ s)
        z = self.slope * ((self.weight[i] @ s) / n if n else 0.0) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, share: float) -> Model:
    """A model of the rows; ``share`` is that of label 1 among all labelled texts."""
    y = np.where(labels > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        p = np.clip(share, 0.01, 0.99)
        return Model(np.zeros(SIZE), scale, 1.0, float(np.log(p / (1 - p))))
    margins = np.zeros(len(rows))
    part = np.arange(len(rows)) % 2
    for half in (0, 1):
        own, rest = np.flatnonzero(part != half), np.flatnonzero(part == half)
        w = descend([rows[k] for k in own], y[own], scale)
        margins[rest] = [w[rows[k]] @ unit(scale[rows[k]]) for k in rest]
    weight = np.where(y > 0, share / (y > 0).sum(), (1 - share) / (y < 0).sum()) * len(y)
    slope, offset = calibrate(margins, y, weight)
    return Model(descend(rows, y, scale), scale, slope, offset)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, save) -> DataFrame:
    """``id, text, label`` of every row of ``docs`` with a label, written once."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label")).where("id IS NOT NULL")
    known = save(known, "labels")
    rows = maybe(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), F.col("id"), known, F.col("id"))
    return save(rows.where("__maybe").drop("__maybe").join(known.hint("merge"), "id"), "labelled")


def fit_sample(labelled: DataFrame, per_class: int) -> DataFrame:
    """``h, bits, label`` of ``per_class`` texts of each class at most: one of each id, those whose ids hash lowest."""
    keyed = labelled.withColumn("h", F.xxhash64("id")).withColumn("t", F.xxhash64("text"))
    ids = keyed.groupBy("label", "h", "id").agg(F.min("t").alias("t"))
    low, high = (ids.where(F.col("label") == c).orderBy("h", "id").limit(per_class) for c in (0, 1))
    rows = keyed.join(F.broadcast(low.unionByName(high)), ["label", "h", "id", "t"]).dropDuplicates(["label", "h", "id"])
    return rows.select("h", "text", "label").mapInArrow(_packed_rows, "h long, bits binary, label int")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = ROWS_PER_CLASS, most: int = FIT_FEATURES) -> Model | None:
    """A model of ``label`` (0 or 1); None without labelled texts.

    Ratios cover all labelled texts, repeated rows as often as they stand; the fit takes
    one text of each id, ``per_class`` of each class and ``most`` indicators in all at
    most, those whose ids hash lowest (equal hashes by id; of an id's texts that with the
    lowest hash). An id with several labels has the largest; rows without an id or a label
    teach nothing. A text of any length is ``SIZE`` bits to the driver.
    """
    with scratch(docs.sparkSession) as save:
        labelled = labelled_texts(docs, labels, id_col, text, label, save)
        counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
        if not counts:
            return None
        scale = log_ratios(labelled)
        found = in_fit([(r["h"], bytes(r["bits"]), r["label"]) for r in fit_sample(labelled, per_class).collect()], most)
    return fit([row for row, _ in found], np.array([y for _, y in found]), scale, counts.get(1, 0) / sum(counts.values()))


def _score_rows(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.score(raw) if model else 0.5 for raw in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, score`` (0 to 1, higher: label 1 likelier) of every whole text.

    Null and empty texts are scored by the bias alone; without a model every score is
    0.5. Ids may be null or repeat; other columns aren't read; no rows give no rows. Texts
    that agree have the same score; a text's memory is some 20 times its length.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_score_rows(model), with_id(docs, id_col, "score double")).withColumnRenamed("id", id_col)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out), labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
