"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a linear classifier over hashed
byte n-grams, fitted by least squares, predicts whether the text's language has it
set. Decoding adds up, over the bits, the loss of each codeword against the
classifiers' margins; the nearest codeword wins, and a text whose second nearest is
about as near is flagged as ambiguous. A text that is far from every codeword is of no
language learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, with_id

BITS = 13
ROWS_PER_LANGUAGE = 400
MAX_ROWS = 3000
RIDGE = 1.0
SHARPNESS = 4.0
AMBIGUOUS = 0.75  # a score below it flags the prediction
FAR = 0.84  # loss a bit of the nearest codeword (1: no evidence) above which a text is of no language learnt
ENOUGH = 40  # letters; a shorter text isn't called far, as few n-grams say little
UNKNOWN = "und"


def codewords(k: int) -> np.ndarray:
    """``k`` rows of +1 and -1: all splits of the languages for few of them, else the best of random codes.

    Any two rows of the exhaustive code differ in over half of the bits.
    """
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        splits = np.arange(1 << (k - 1))[:-1]  # the first language is set in every split
        return np.array([np.ones(len(splits)), *[2.0 * (splits >> (k - 2 - r) & 1) - 1 for r in range(k - 1)]])
    width = int(np.ceil(10 * np.log2(k)))
    rng = np.random.default_rng(k)
    best, apart = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (k, width)) * 2.0 - 1
        d = int(((width - code @ code.T) / 2 + width * np.eye(k)).min())
        varied = (abs(code.sum(axis=0)) < k).all()
        if d > apart and varied:
            best, apart = code, d
    return best


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def enough_letters(text: str) -> bool:
    return next(islice(filter(str.isalpha, text), ENOUGH - 1, None), None) is not None


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of the counts of hashed byte n-grams, n from 1 to 4, of the lower-case text."""
    b = np.frombuffer(text.lower().encode(errors="replace"), np.uint8).astype(np.uint32)
    total = np.zeros(1 << BITS, np.int64)
    g = b
    for n in range(1, 5):
        if n > 1:
            if len(b) < n:
                break
            g = (g[:-1] << np.uint32(8)) | b[n - 1 :]  # the fifth byte back falls out
        h = ((g + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        total += np.bincount(h, minlength=1 << BITS)
    x = np.sqrt(total).astype(np.float32)
    norm = float(np.sqrt(total.sum()))
    return x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each row: language index, score (0 to 1), ambiguity, and the nearest codeword's loss a bit.

        Of codewords equally near, that of the language first by name counts.
        """
        margins = x @ self.weights + self.offset
        loss = np.exp(-np.clip(margins[:, None, :] * self.code[None], -2, 2)).sum(axis=2)
        p = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)) / max(1, self.code.shape[1] ** 0.5))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        return best, score, score < AMBIGUOUS, loss.min(axis=1) / self.code.shape[1]


def fit(x: np.ndarray, languages: list[str]) -> Model | None:
    """Least squares of every bit on the rows' features; None without a row. ``x`` is used up."""
    names = sorted(set(languages))
    if not names:
        return None
    code = codewords(len(names))
    index = {n: k for k, n in enumerate(names)}
    which = np.array([index[n] for n in languages])
    weight = 1.0 / np.bincount(which, minlength=len(names))[which]  # languages count alike
    weight *= len(which) / weight.sum()
    y = code[which]
    mean_x, mean_y = (weight / weight.sum()).astype(np.float32) @ x, np.average(y, 0, weight)
    root = np.sqrt(weight)[:, None]
    x -= mean_x
    x *= root.astype(np.float32)
    gram = (x @ x.T).astype(np.float64)
    gram[np.diag_indices(len(x))] += RIDGE
    w = x.T @ np.linalg.solve(gram, (y - mean_y) * root)
    return Model(names, code, w.astype(np.float32), (mean_y - mean_x @ w).astype(np.float32))


def training_rows(docs: DataFrame, id_col: str, text: str, lang: str, per_language: int = ROWS_PER_LANGUAGE, most: int = MAX_ROWS) -> DataFrame:
    """A bounded sample, ``lang, h, text``: one row of each of the ids of a language whose hashes are smallest.

    At most ``per_language`` rows of a language and ``most`` rows in all (beyond ``most``
    languages, those with the most ids); rows without id, text or language aren't taken.
    The sample is a function of the rows: hashes that agree are ordered by id, and of an
    id's texts that with the smallest hash is taken.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    counts = F.broadcast(counts)  # ``most`` rows
    share = max(1, min(per_language, most // max(1, counts.count())))
    # a threshold on the hash leaves a quarter more ids, and 20, than are ranked and taken
    low = F.bitwise_not(F.lit(-(2**63))).bitwiseAND(F.col("h")) <= F.lit(2.0**63 * (1.25 * share + 20)) / F.col("n")
    some = rows.join(counts, "lang").where(low).select("lang", "h", "id", F.xxhash64("text").alias("t"))
    some = some.groupBy("lang", "h", "id").agg(F.min("t").alias("t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    picked = some.withColumn("rank", rank).where(F.col("rank") <= share).drop("rank")
    found = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "h", "id", "t"])
    return found.dropDuplicates(["lang", "h", "id"]).select("lang", "h", "text")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The non-zero features of each text that has a letter: 48 KB at most, however long the text."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for lang, h, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if has_letter(text):
                x = features(text)
                at = np.flatnonzero(x)
                for column, value in zip(out, (lang, h, at.astype(np.uint16).tobytes(), x[at].tobytes()), strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["lang", "h", "at", "x"])


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model fitted on ``training_rows``; rows without text, language or letter teach nothing."""
    rows = training_rows(docs, id_col, text, lang).mapInArrow(_feature_rows, "lang string, h long, at binary, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], r["at"], r["x"]))
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    return fit(x, [r["lang"] for r in rows])


def _predict_rows(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                known = [k for k, t in enumerate(texts) if t and has_letter(t)]
                reject = np.ones(len(texts), bool)
                reject[known] = False
                if known and model:
                    best, s, a, loss = model.decode(np.array([features(texts[k]) for k in known]))
                    score[known], unsure[known] = s, a
                    reject[known] = (loss > FAR) & [enough_letters(texts[k]) for k in known]
                    for k, b in zip(known, best.tolist(), strict=True):
                        lang[k] = model.languages[b]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(unsure), pa.array(reject)], ["id", "lang_pred", "score", "ambiguous", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, ambiguous, rejected`` of every whole text.

    A text that is null or has no letter is ``rejected`` and ``und`` with score 0. A text
    of ``ENOUGH`` letters is also ``rejected`` where its nearest codeword's loss a bit is
    above ``FAR``: it has the nearest language, but isn't of one learnt.
    Without a model (no labelled rows to learn from) every text is ``und``, but those
    with a letter aren't rejected. Ids may be null or repeat; other
    columns aren't read; no rows give no rows. A text's memory is some 20 times its length.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict_rows(model), with_id(docs, id_col, "lang_pred string, score double, ambiguous boolean, rejected boolean")).withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns.

    The model learns from the rows outside the held-out fold; ``rejected`` texts go: those
    without a letter, and those of ``ENOUGH`` letters whose predicted bits are far from
    every language's codeword.
    """
    model = train(docs.where(fold(F.col(id_col), 3) != 1), id_col, text, lang)
    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = predict(docs.select(key.alias("row"), F.col(text).alias("text")), model, "row", "text")
    return found.where("not rejected").select("row.*")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
