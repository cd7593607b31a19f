"""Near-dedup by the Jaccard similarity of shingle sets, with candidates from MinHash bands.

A text's set has the XXH64 of its five-word shingles. Of 128 minima over the set, four
at a time give the keys of 32 bands; sets that share a key are compared as they are, and
linked if their similarity is 0.8 or more. A pair of similarity s shares no key with
odds of (1 - s**4)**32, 5e-8 at 0.8. The sets lie in files in the shared folder, which
every worker maps into memory. Equal sets are one node throughout, and a key's sets give
the edges of a spanning forest, never all pairs.

Sets that share a template share keys without being similar. A key with more than
``CROWD`` sets isn't compared by its task: its sets meet again on their rarest
shingles. Two sets of similarity s or more have one in common among the first
``size - ceil(s * size) + 1`` of either, whatever the order, so with rare shingles first
those of a template, which stand last, bring no one together, and no pair is lost.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, keep_rows, keyed, posix, remove, saved, scratch, shared_path, texts, with_id
from .simhash import components

WIDTH = 5
BANDS, ROWS = 32, 4
SIMILAR = (4, 5)  # the least similarity, as a fraction
OFFSET_BITS = 40  # of a place: the rest is the file
SLICE = 1 << 16
CROWD = 512  # sets of a key that its task compares
MAPPED = 4096  # files that a worker has mapped at a time
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one function of 64 bits that spreads every bit."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of the ``width``-word shingles of the ASCII-lower-cased text.

    Words are what ASCII white space parts; fewer than ``width``, or none, are one shingle.
    """
    words = raw.lower().split()
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of each set's bands, a row a set."""
    out = np.empty((len(sets), BANDS), np.uint64)
    a = 0
    while a < len(sets):
        b, n = a, 0
        while b < len(sets) and (n == 0 or n + len(sets[b]) <= SLICE):
            n += len(sets[b])
            b += 1
        h = np.concatenate(sets[a:b])
        starts = np.cumsum([0, *map(len, sets[a : b - 1])])
        least = np.stack([np.minimum.reduceat(h * f, starts) for f in _FACTORS])
        for k in range(BANDS):
            key = np.full(b - a, k, np.uint64)
            for row in least[k * ROWS : (k + 1) * ROWS]:
                key = mix(key) + row
            out[a:b, k] = mix(key)
        a = b
    return out


def _set_rows(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().taskAttemptId(), 0
        with open(f"{folder}/{number}", "wb") as f:
            for batch in batches:
                sets = [shingles(raw, width) for raw in texts(batch.column(1))]
                places = []
                for s in sets:  # its length, then its members
                    f.write(np.uint64(len(s)).tobytes() + s.tobytes())
                    places.append(number << OFFSET_BITS | at)
                    at += len(s) + 1
                fp = [xxhash.xxh3_128_digest(s) for s in sets]
                keys = pa.array(band_keys(sets).view(np.int64).reshape(-1))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), keys)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary()), pa.array(places, pa.int64()), keys], ["id", "fp", "place", "keys"])

    return run


class Sets:
    """Sets by their places, from files mapped on first use; the file that wasn't used for longest is let go."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, OrderedDict()

    def __call__(self, place: int) -> np.ndarray:
        number, at = place >> OFFSET_BITS, place & (1 << OFFSET_BITS) - 1
        if number not in self.files:
            if len(self.files) >= MAPPED:
                self.files.popitem(last=False)
            self.files[number] = np.memmap(f"{self.folder}/{number}", np.uint64, "r")
        self.files.move_to_end(number)
        f = self.files[number]
        return np.array(f[at + 1 : at + 1 + int(f[at])])  # a copy, so that no set keeps a file mapped


def near(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which sets are similar to ``one``."""
    up, down = SIMILAR
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = (np.minimum(sizes, len(one)) * down >= np.maximum(sizes, len(one)) * up).nonzero()[0]
    both = np.zeros(len(sets), np.int64)
    a = 0
    while a < len(out):
        b = a + max(1, int(np.searchsorted(np.cumsum(sizes[out[a:]]), SLICE, "right")))
        h = np.concatenate([sets[k] for k in out[a:b]])
        found = one[np.minimum(np.searchsorted(one, h), len(one) - 1)] == h
        both[out[a:b]] = np.add.reduceat(found.astype(np.int64), np.cumsum([0, *sizes[out[a : b - 1]]]))
        a = b
    return both * (up + down) >= (sizes + len(one)) * up


def _forest(places: list[int], sets: Sets) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a key's similar pairs; as ``simhash._forest``."""
    edges, left = [], [(p, sets(p)) for p in places]
    while left:
        stack = [left.pop()]
        while stack and left:
            a, one = stack.pop()
            hit = near(one, [s for _, s in left])
            if hit.any():
                stack += [x for x, h in zip(left, hit, strict=True) if h]
                edges += [(a, x[0]) for x, h in zip(left, hit, strict=True) if h]
                left = [x for x, h in zip(left, hit, strict=True) if not h]
    return edges


def _edge_rows(folder: str, crowd: int | None = None):
    """Edges of each key's forest, of rows sorted by ``key``; of a key with more than ``crowd`` sets a row for each set, with no other end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder)
        edges: list[tuple[int, int | None]] = []
        key, held, crowded = None, [], False  # of the last key, which may go on in the next batch

        def add(places: np.ndarray) -> None:
            nonlocal held, crowded
            held.append(places)
            if crowded or crowd is not None and sum(map(len, held)) > crowd:
                edges.extend((p, None) for p in np.concatenate(held).tolist())
                held, crowded = [], True

        def close() -> None:
            nonlocal held, crowded
            if held and sum(map(len, held)) > 1:
                edges.extend(_forest(np.concatenate(held).tolist(), sets))
            held, crowded = [], False

        def rows() -> pa.RecordBatch:
            a, b = zip(*edges, strict=True) if edges else ((), ())
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys, places = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            if not len(keys):
                continue
            ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
            starts = np.append(0, ends[:-1])
            wanted = ends - starts > 1
            wanted[[0, -1]] = True  # they may go on in another batch; other keys of one set link nothing
            for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
                if key is None or keys[a] != key:
                    close()
                    key = keys[a]
                add(places[a:b])
            yield rows()
        close()
        yield rows()

    return run


def _shingle_rows(folder: str):
    """The shingles of sets, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder)
        for batch in batches:
            for place in batch.column(0).to_pylist():
                s = sets(place)
                for k in range(0, len(s), SLICE):
                    part = s[k : k + SLICE].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), place)), pa.array(np.full(len(part), len(s)))], ["shingle", "place", "size"])

    return run


def crowd_edges(places: DataFrame, folder: str, save) -> DataFrame:
    """``a, b``: edges that connect what similar pairs of sets connect, by the sets' rarest shingles."""
    up, down = SIMILAR
    shingle_rows = save(places.mapInArrow(_shingle_rows(folder), "shingle long, place long, size long"), "crowd")
    counts = save(shingle_rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "crowd-counts")
    common = join_groups(shingle_rows, counts, "shingle", "df")  # a shingle that no other set has is first in the order and links nothing
    own = Window.partitionBy("place")
    ranked = common.select("shingle", "place", "size", F.row_number().over(own.orderBy("df", "shingle")).alias("rank"), F.count(F.lit(1)).over(own).alias("n"))
    first = ranked.where(F.expr(f"rank + (size - n) <= size - ceil({up} * size / {down}) + 1"))
    return first.select("shingle", "place").repartition("shingle").sortWithinPartitions("shingle", "place").mapInArrow(_edge_rows(folder), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """``id_col, component_id, component_size`` of every row.

    Texts whose sets are similar are linked, and ``component_id`` is the smallest id that
    links reach, itself included. Null and empty texts have equal sets; null ids take part
    but are the component's id only where it has no other; repeated rows share a
    component. A similarity of just 0.8 links. Very long texts are read where they lie:
    what is moved are their keys, 8 bytes each, and their shingles only where a key is
    crowded (more than ``crowd`` sets, which changes no result). Other columns aren't read; no rows give no rows.
    """
    path = shared_path(docs.sparkSession, "sets")
    os.makedirs(posix(path), exist_ok=True)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = saved(rows.mapInArrow(_set_rows(posix(path), width), with_id(docs, id_col, "fp binary, place long, keys array<long>")), "sets")
    nodes = saved(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("group_size"), F.min("place").alias("place")), "nodes")
    keys = rows.join(nodes.select("place"), "place", "left_semi").select(F.explode("keys").alias("key"), "place")
    with scratch(docs.sparkSession) as save:
        edges = save(keys.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_edge_rows(posix(path), crowd), "a long, b long").distinct(), "key-edges")
        crowded = edges.where("b IS NULL").select("a")
        edges = edges.where("b IS NOT NULL")
        if crowded.first():
            edges = edges.unionByName(crowd_edges(crowded, posix(path), save))
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
