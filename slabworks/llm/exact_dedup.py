"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of the last 16 bytes hits a mask, so equal
passages are cut alike wherever they stand. Each chunk has a 128-bit identifier.
Chunks are shuffled once, one copy of each per task, and every identifier is
verified: all contents that carry it must be the same bytes. A task drops a chunk that it
has seen only where a second digest, of another family, agrees as well; what remains is
compared byte by byte. If two contents of an identifier differ, the identifiers are made
anew with another seed. After that a document is the ordered
list of its chunk identifiers, its *recipe* (16 bytes for about 1 KB of text), and
only recipes are compared and moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, keep_rows, keyed, saved, texts, with_id

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 256, 10, 8192
SEEN_LIMIT = 200_000
SEEDS = 8
_TO_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def normalise(raw: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; nothing is stripped."""
    raw = raw.translate(_TO_SPACE)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``, the last being its length; none for an empty text."""
    n = len(raw)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    for k in (1, 2, 4, 8):  # h[i] becomes the hash of the 16 bytes that end at i
        h[k:] += h[:-k] << np.uint32(k)
    marks = np.flatnonzero((h >> np.uint32(16)) & np.uint32((1 << MASK_BITS) - 1) == 0) + 1
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if m - last >= MIN_CHUNK or m == n:
            if m > last:
                out.append(m)
            last = m
    return out


def chunks(raw: bytes) -> list[bytes]:
    out, last = [], 0
    for end in cuts(raw):
        out.append(raw[last:end])
        last = end
    return out


def identifier(chunk: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed)


def _chunk_rows(seed: int, identify: Callable[[bytes, int], bytes] = identifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        for batch in batches:
            ids, contents, size = [], [], 0
            for raw in texts(batch.column(0)):
                for c in chunks(normalise(raw)):
                    k, second = identify(c, seed), hashlib.blake2b(c, digest_size=16).digest()
                    if seen.get(k) != second:
                        if len(seen) >= SEEN_LIMIT:
                            seen.clear()
                        seen[k] = second
                        ids.append(k)
                        contents.append(c)
                        size += len(c)
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], ["chunk_id", "content"])
                            ids, contents, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], ["chunk_id", "content"])

    return run


def _recipe_rows(seed: int, identify: Callable[[bytes, int], bytes] = identifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipe, sha = [], []
            for raw in texts(batch.column(1)):
                raw = normalise(raw)
                recipe.append(b"".join(identify(c, seed) for c in chunks(raw)))
                sha.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipe, pa.binary()), pa.array(sha, pa.string())], ["id", "recipe", "text_sha256"])

    return run


def chunk_store(docs: DataFrame, text: str = "text", seed: int = 0, identify: Callable[[bytes, int], bytes] = identifier) -> DataFrame:
    """The distinct chunks of a corpus: ``chunk_id, content, verified``.

    ``verified`` is false where chunks that differ share an identifier.
    """
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_chunk_rows(seed, identify), "chunk_id binary, content binary")
    return rows.groupBy("chunk_id").agg(F.min("content").alias("content"), F.max("content").alias("other")).select("chunk_id", "content", (F.col("content") == F.col("other")).alias("verified"))


def verified_recipes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", identify: Callable[[bytes, int], bytes] = identifier) -> DataFrame:
    """``id, recipe, text_sha256`` of each row, under a seed whose identifiers are verified.

    An ``identify`` whose identifiers aren't told apart by ``SEEDS`` seeds is an error.
    """
    for seed in range(SEEDS):
        if chunk_store(docs, text, seed, identify).where(~F.col("verified")).isEmpty():
            break
    else:
        raise ValueError(f"chunks that differ share identifiers under {SEEDS} seeds")
    schema = with_id(docs, id_col, "recipe binary, text_sha256 string")
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_recipe_rows(seed, identify), schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", identify: Callable[[bytes, int], bytes] = identifier) -> DataFrame:
    """Groups of equal texts: ``id, keep_id, group_size, kept, text_sha256, n_chunks``.

    A null text counts as empty, and all empty texts are equal. ``keep_id`` is the
    smallest id of the group that isn't null (null if all are); rows that repeat an
    id and its text are each ``kept`` if their id is. A null id is kept only where
    the whole group has none. Other columns are not read, so their names don't
    matter; no rows give no rows. ``group_size`` counts rows. A text of any length is
    cut into chunks of ``MAX_CHUNK`` bytes at most, one text at a time in memory.
    """
    rows = saved(verified_recipes(docs, id_col, text, identify), "recipes")
    groups = saved(rows.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return join_groups(rows, groups, "recipe").select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", (F.octet_length("recipe") / 16).cast("long").alias("n_chunks")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group.

    The row with the smallest id stays, before rows without one; of rows that repeat
    the id, the one whose text's digest is smallest.
    """
    found = exact_dedup(keyed(docs, id_col, text).select("__key", text), "__key", text)
    return keep_rows(docs, found, id_col, text)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
