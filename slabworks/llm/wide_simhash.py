"""Near-dedup by SimHash wide enough for a similarity: pigeonhole blocks, Hamming distance, then the sets themselves.

A text's set has the XXH64 of its five-word shingles, as in ``jaccard``. Its fingerprint
has 2,048 bits, each set if it is in over half the hashes, in 256 blocks of 8. Two sets
of Jaccard similarity 0.8 differ in 15.2 % of the bits (up to 15.8 % where they are
short), so blocks agree with odds of 0.27 or so, and two blocks that stand side by side
(round the ring) give each of the 256 keys. That no two neighbours agree has odds of
1.4e-7 at 15.2 % (7e-7 at 15.8 %, 1e-8 at a similarity of 0.82). Rows that share a key
are told apart by the Hamming distance of 256 of the bits (128 between unlike sets; 80
is seven deviations past 0.8), and what is left is compared as it is: linked are sets of
similarity 0.8 or more, never others.

Fingerprints of a few shingles are coarse: sets of up to ``SHORT`` meet each other on
the first of their shingles by hash, of which similar sets have one in common, so that no
pair is lost. The sets of a key that more than ``jaccard.CROWD`` sets share meet on their
rarest shingles (``jaccard.crowd_edges``), with the same certainty. Keys have 16 bits, so that
unlike texts alone crowd them beyond some 30 million texts; then more and more sets meet on their shingles.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, keep_rows, keyed, posix, remove, saved, scratch, shared_path, texts, with_id
from .jaccard import CROWD, MAPPED, OFFSET_BITS, SIMILAR, WIDTH, Sets, _edge_rows, crowd_edges, mix, shingles
from .simhash import components

BLOCKS = 256  # of a byte each
PRINT = 4  # words of the fingerprint whose distance is taken
FAR = 80  # the most bits of these in which similar sets differ
SHORT = 20  # shingles of a set whose fingerprint is too coarse
ROWS = 1 << 16  # whose distances are taken at a time
_SALTS = np.random.default_rng(2048).integers(0, 1 << 63, BLOCKS // 8, np.uint64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bytes of a set's SimHash; where as many bits are set as not, that of the first hash decides."""
    ones, first = np.zeros(8 * BLOCKS, np.int64), None
    for k in range(0, len(hashes), 255):  # counts fit a byte
        words = mix(hashes[k : k + 255, None] ^ _SALTS)
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        first = bits[0].copy() if first is None else first
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones + first > len(hashes))


def keys(prints: np.ndarray) -> np.ndarray:
    """The keys of fingerprints, a row each: two neighbouring blocks, and which they are."""
    b = prints.astype(np.int32)
    return np.arange(BLOCKS, dtype=np.int32) << 16 | b << 8 | np.roll(b, -1, axis=1)


def first(hashes: np.ndarray, short: int) -> np.ndarray:
    """The shingles on which a set of up to ``short`` meets others, none for a set that is similar to equal ones only."""
    (up, down), n = SIMILAR, len(hashes)
    return hashes[: n + up * n // -down + 1] if n <= short and n * (down - up) >= up else hashes[:0]


def _set_rows(folder: str, width: int, short: int):
    """Writes a file of sets, and one of 256 bits and the place of each set; a slot is the number of a set in its file.

    ``bits`` are those of sets that can be similar to one of more than ``short`` shingles, ``first`` the shingles of shorter sets.
    """
    up, down = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, slot = TaskContext.get().taskAttemptId() << OFFSET_BITS, 0, 0
        with open(f"{folder}/{number >> OFFSET_BITS}", "wb") as f, open(f"{folder}/{number >> OFFSET_BITS}.prints", "wb") as g:
            for batch in batches:
                fp, places, prints, firsts = [], [], [], []
                for raw in texts(batch.column(1)):
                    s = shingles(raw, width)
                    f.write(np.uint64(len(s)).tobytes() + s.tobytes())
                    bits = fingerprint(s)
                    g.write(bits[: 8 * PRINT].tobytes() + np.uint64(number | at).tobytes())
                    fp.append(xxhash.xxh3_128_digest(s))
                    places.append(number | at)
                    prints.append(bits.tobytes() if len(s) * down > short * up else b"")
                    firsts.append(first(s, short).tobytes())
                    at += len(s) + 1
                slots = pa.array(np.arange(slot, slot + len(fp)) + number)
                slot += len(fp)
                columns = [pa.array(fp, pa.binary()), pa.array(places, pa.int64()), slots, pa.array(prints, pa.binary()), pa.array(firsts, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "fp", "place", "slot", "bits", "first"])

    return run


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, slot``, a row for each key of ``slot, bits, first``; keys that are shingles are negative."""
    for batch in batches:
        slots, bits, firsts = batch.column(0).to_numpy(), list(texts(batch.column(1))), list(texts(batch.column(2)))
        prints = np.frombuffer(b"".join(bits), np.uint8).reshape(-1, BLOCKS)
        shingle = (np.frombuffer(b"".join(firsts), np.uint64) | np.uint64(1 << 63)).view(np.int64)
        key = np.append(keys(prints).astype(np.int64), shingle)
        slot = np.append(np.repeat(slots, [BLOCKS * (len(b) > 0) for b in bits]), np.repeat(slots, [len(f) // 8 for f in firsts]))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(slot)], ["key", "slot"])


class Prints(Sets):
    """256 bits and places of slots, from files mapped on first use."""

    def __call__(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(slots)
        by = slots[order]
        out = np.empty((len(slots), PRINT + 1), np.uint64)
        ends = np.flatnonzero(np.append(by[1:] >> OFFSET_BITS != by[:-1] >> OFFSET_BITS, True)[: len(by)]) + 1
        for a, b in zip([0, *ends[:-1]], ends):
            number = int(by[a]) >> OFFSET_BITS
            if number not in self.files:
                if len(self.files) >= MAPPED:
                    self.files.popitem(last=False)
                self.files[number] = np.memmap(f"{self.folder}/{number}.prints", np.uint64, "r").reshape(-1, PRINT + 1)
            self.files.move_to_end(number)
            out[order[a:b]] = self.files[number][by[a:b] & (1 << OFFSET_BITS) - 1]
        return out[:, :PRINT], out[:, PRINT].view(np.int64)


def _mates(keys: np.ndarray, prints: np.ndarray, far: int) -> np.ndarray:
    """Which rows, sorted by ``keys``, have another within ``far`` bits that shares their key."""
    hit = np.zeros(len(keys), bool)
    step, at = 1, np.arange(len(keys) - 1)
    while len(at):
        at = at[keys[at] == keys[at + step]]
        close = at[np.bitwise_count(prints[at] ^ prints[at + step]).sum(axis=1, dtype=np.int64) <= far]
        hit[close] = hit[close + step] = True
        step += 1
        at = at[at + step < len(keys)]
    return hit


def _near_rows(folder: str, crowd: int, far: int):
    """``key, place`` of the rows of ``key, slot`` that have a mate, and of all rows of a key that is a shingle or has more than ``crowd``; sorted by ``key`` as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints(folder)
        held, n, passed = [], 0, None  # passed: a crowded key that may go on
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                n += batch.num_rows
                if n < ROWS:
                    continue
            if not n:
                continue
            k, slots = map(np.concatenate, zip(*held, strict=True))
            held, n = [], 0
            if batch is not None:  # the last key may go on, too
                last = int(np.searchsorted(k, k[-1]))
                if len(k) - last > crowd:
                    passed, last = k[-1], len(k)
                elif k[-1] == passed:
                    last = len(k)
                held, n = [(k[last:], slots[last:])], len(k) - last
                k, slots = k[:last], slots[:last]
            if not len(k):
                continue
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            sizes = np.repeat(np.diff(np.append(starts, len(k))), np.diff(np.append(starts, len(k))))
            crowded = sizes > crowd
            if passed is not None:
                crowded |= k == passed
            few = np.flatnonzero(~crowded & (sizes > 1) & (k >= 0))
            bits, _ = prints(slots[few])
            wanted = crowded | (sizes > 1) & (k < 0)
            wanted[few] |= _mates(k[few], bits, far)
            _, places = prints(slots[wanted])
            yield pa.RecordBatch.from_arrays([pa.array(k[wanted]), pa.array(places)], ["key", "place"])

    return run


def _verified_rows(folder: str, crowd: int, far: int):
    """Edges of the forest of each key's similar sets; a row without another end for each set of a crowded key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _edge_rows(folder, crowd)(_near_rows(folder, crowd, far)(batches))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, crowd: int = CROWD, short: int = SHORT) -> DataFrame:
    """``id_col, component_id, component_size`` of every row.

    Texts whose sets of shingles have a similarity of 0.8 or more are linked, and
    ``component_id`` is the smallest id that links reach, itself included. Null and empty
    texts have equal sets; null ids take part but are the component's id only where it has
    no other; repeated rows share a component. Very long texts are read where they lie:
    what is moved are 256 keys a set, and shingles only of short sets (five at most) and
    where a key is crowded. ``crowd`` and ``short`` change no result but by the odds that the module
    names. Other columns aren't read; no rows give no rows.
    """
    path = shared_path(docs.sparkSession, "sets")
    folder = posix(path)
    os.makedirs(folder, exist_ok=True)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = saved(rows.mapInArrow(_set_rows(folder, width, short), with_id(docs, id_col, "fp binary, place long, slot long, bits binary, first binary")), "sets")
    nodes = saved(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("group_size"), F.min("place").alias("place")), "nodes")
    sets = rows.join(nodes.select("place"), "place", "left_semi").select("slot", "bits", "first")
    pairs = sets.mapInArrow(_key_rows, "key long, slot long").repartition("key").sortWithinPartitions("key", "slot")
    with scratch(docs.sparkSession) as save:
        edges = save(pairs.mapInArrow(_verified_rows(folder, crowd, FAR), "a long, b long").distinct(), "key-edges")
        crowded = edges.where("b IS NULL").select("a")
        edges = edges.where("b IS NOT NULL")
        if crowded.first():
            edges = edges.unionByName(crowd_edges(crowded, folder, save))
        found = components(edges)
    remove(docs.sparkSession, path)
    rooted = saved(nodes.join(found, nodes.place == found.node, "left").select("fp", "least", "group_size", F.coalesce("root", "place").alias("root")), "rooted")
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("group_size").alias("component_size"))
    groups = saved(rooted.join(roots, "root").select("fp", "group_size", "component_id", "component_size"), "groups")
    return join_groups(rows.select("id", "fp"), groups, "fp").select(F.col("id").alias(id_col), "component_id", "component_size")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of each component stays, with all columns, as in ``simhash.keep_first``."""
    found = near_duplicates(keyed(docs, id_col, text).select("__key", text), "__key", text, width)
    return keep_rows(docs, found.withColumn("kept", F.expr("__key = component_id")), id_col, text, "component_size")
