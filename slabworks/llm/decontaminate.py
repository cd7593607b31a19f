"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters that occurs in a document with at most e edits shares at
least m - q + 1 - q*e of its q-grams with that place (the q-gram lemma), and all of
them lie on diagonals (document position less passage position) that differ by at
most e. So q-grams in common are counted in bands of 2(e + 1) diagonals that overlap
by half, which contain every run of e + 1 diagonals; bands that reach the bound are
regions, and each region is verified by a banded alignment. Q-grams, places and edits
are of characters.

The benchmark's q-grams are indexed in blocks of bounded size, written by tasks to the
shared folder and mapped by the workers, so neither the driver nor a worker ever holds
the benchmark. A table of bits over all blocks, of at most 32 MB, says which of a
document's q-grams are looked up at all; those meet one block after the other.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import posix, shared_path, texts, with_id, write_atomic

Q = 12
EDIT_RATE = 0.06
BLOCK_CHARS = 4_000_000
PAIRS = 1 << 20  # of places that are counted at once
SLICE = 1 << 20
DIAGONALS = 1 << 16  # that are aligned at once
TABLE_BITS = (16, 28)
LISTS = ("items", "edits", "starts", "ends")
ARRAYS = ("gram", "first", "item", "place", "short", "short_item")
_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F
_B1, _B2, _B4 = (np.uint64(pow(_B, k, 1 << 64)) for k in (1, 2, 4))


def normalise(raw: bytes) -> str:
    """Lower case; what is no letter, digit or non-ASCII character becomes one space."""
    if not raw.isascii():
        raw = raw.decode(errors="replace").lower().encode()
    return b" ".join(raw.lower().translate(_KEEP).split()).decode()


def points(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(p: np.ndarray) -> np.ndarray:
    """A 64-bit value of each window of ``Q`` (12) code points; windows of 2, 4 and 8 are put together."""
    n = len(p) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = (p.astype(np.uint64) + np.uint64(1)) * _A
    one ^= one >> np.uint64(29)
    two = one[:-1] * _B1 + one[1:]
    four = two[:-2] * _B2 + two[2:]
    out = (four[:-4] * _B4 + four[4:])[:n] * _B4 + four[8 : 8 + n]
    out ^= out >> np.uint64(32)
    out *= _A
    return out ^ (out >> np.uint64(29))


def budget(m: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for a passage of ``m`` characters: its share, and few enough that the bound stays above zero."""
    return max(0, min(int(m * rate), (m - Q) // Q))


def alignment(item: np.ndarray, region: np.ndarray, e: int) -> tuple[int, int, int] | None:
    """Fewest edits of ``item`` against any stretch of ``region``: ``edits, start, end``, or None above ``e``.

    Cells are kept for a band of diagonals: the region has no more room than edits
    and the band's width need, so each row has ``len(region) - len(item) + 2e + 1`` cells.
    Of places with as few edits the one that ends first counts.
    """
    m, n = len(item), len(region)
    low, width = -e, max(1, n - m + 2 * e + 1)
    far = m + n + 1
    text = np.full(width + m + 2 * e + 2, -1, np.int32)
    text[e : e + n] = region  # text[e + j] is region[j]
    j0 = np.arange(width, dtype=np.int32) + np.int32(low)  # row i has column i + j0
    cost = np.where((j0 >= 0) & (j0 <= n), 0, far).astype(np.int32)
    start = j0.copy()
    steps = np.arange(width, dtype=np.int32)
    for i in range(1, m + 1):
        swap = cost + (text[i - 1 : i - 1 + width] != item[i - 1])
        drop = np.append(cost[1:], np.int32(far)) + np.int32(1)
        best = np.minimum(swap, drop)
        from_ = np.where(swap <= drop, start, np.append(start[1:], np.int32(0)))
        outside = (max(0, -low - i), min(width, n - low - i + 1))  # columns below 0 and above n
        best[: outside[0]] = far
        best[max(0, outside[1]) :] = far
        gap = best - steps
        run = np.minimum.accumulate(gap)  # insertions along the row
        source = np.maximum.accumulate(np.where(gap == run, steps, 0))
        cost = run + steps
        start = from_[source]
        cost[: outside[0]] = far
        cost[max(0, outside[1]) :] = far
        if cost.min() > e:
            return None
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), int(j0[k] + m)) if cost[k] <= e else None


def _digest(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode())


class Index:
    """The q-grams of some benchmark passages; arrays may be mapped files.

    ``gram`` has the distinct q-grams, ``item`` and ``place`` where each stands, from
    ``first`` of its number on. Passages under ``Q`` characters are in ``short`` by the
    hash of their words.
    """

    def __init__(self, names: pa.Array, passages: pa.Array, arrays: dict[str, np.ndarray], rate: float = EDIT_RATE):
        self.names, self.passages, self.arrays = names, passages, arrays
        self.gram, self.first, self.item, self.place, self.short, self.short_item = (arrays[a] for a in ARRAYS)
        self.length = pc.utf8_length(passages).to_numpy(zero_copy_only=False).astype(np.int64)
        share = np.minimum((self.length * rate).astype(np.int64), (self.length - Q) // Q)
        self.edits = np.maximum(0, share)
        self.need = self.length - Q + 1 - Q * self.edits

    @classmethod
    def of(cls, names: pa.Array, passages: list[str], rate: float = EDIT_RATE) -> Index:
        parts = [grams(points(t)) for t in passages]
        gram = np.concatenate([*parts, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p) for p in parts])
        place = np.concatenate([*[np.arange(len(p), dtype=np.uint32) for p in parts], np.zeros(0, np.uint32)])
        order = np.argsort(gram, kind="stable")
        distinct, first = np.unique(gram[order], return_index=True)
        short = sorted((_digest(t.split(" ")), k) for k, t in enumerate(passages) if t and len(t) < Q)
        arrays = {"gram": distinct, "first": np.append(first, len(gram)), "item": item[order], "place": place[order]}
        arrays |= {"short": np.array([h for h, _ in short], np.uint64), "short_item": np.array([k for _, k in short], np.uint32)}
        return cls(names, pa.array(passages, pa.large_string()), arrays, rate)

    def save(self, path: str) -> None:
        for name, array in self.arrays.items():
            write_atomic(f"{path}.{name}.npy", array)
        table = pa.table({"name": self.names, "passage": self.passages})
        tmp = f"{path}.arrow.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        with pa.OSFile(tmp, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        os.replace(tmp, f"{path}.arrow")

    @classmethod
    def load(cls, path: str, rate: float = EDIT_RATE) -> Index:
        table = pa.ipc.open_file(pa.memory_map(f"{path}.arrow")).read_all()
        arrays = {}
        for name in ARRAYS:
            a = np.load(f"{path}.{name}.npy", mmap_mode="r")
            arrays[name] = np.asarray(a) if a.size else np.zeros(0, a.dtype)
        return cls(*(c.combine_chunks() for c in table.columns), arrays, rate)

    @cached_property
    def short_sizes(self) -> list[int]:
        return sorted({len(self.passages[int(k)].as_py().split(" ")) for k in self.short_item})

    def find(self, text: str, at: np.ndarray, gram: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``item index, edits, start, end`` of each passage found in a normalised text, the best place of each.

        ``at`` and ``gram`` have the text's q-grams and their places, at least those of the index.
        """
        out = self.find_short(text) if len(self.short) else {}
        if len(at) and len(self.gram):
            slot = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
            same = self.gram[slot] == gram
            at, slot = at[same], slot[same]
            p = points(text) if len(at) else None
            for k, bands in self.regions(at, slot) if len(at) else ():
                found = self.verified(k, bands, text, p)
                if found:
                    out[k] = found
        return [(k, *v) for k, v in sorted(out.items())]

    def find_short(self, text: str) -> dict[int, tuple[int, int, int]]:
        words, out = text.split(" "), {}
        for size in self.short_sizes:
            hashes = np.array([_digest(words[i : i + size]) for i in range(len(words) - size + 1)], np.uint64)
            slot = np.searchsorted(self.short, hashes)
            for h in np.unique(hashes[self.short[np.minimum(slot, len(self.short) - 1)] == hashes]):
                for j in range(*np.searchsorted(self.short, [h, h + np.uint64(1)]).tolist()):
                    k = int(self.short_item[j])
                    at = f" {text} ".find(f" {self.passages[k].as_py()} ")
                    if at >= 0:
                        out[k] = (0, at, at + int(self.length[k]))
        return out

    def verified(self, k: int, bands: np.ndarray, text: str, p: np.ndarray) -> tuple[int, int, int] | None:
        """The place with the fewest edits, the first of such; an exact one needs no alignment."""
        passage, m, e = self.passages[k].as_py(), int(self.length[k]), int(self.edits[k])
        at = text.find(passage)
        if at >= 0 or e == 0:
            return (0, at, at + m) if at >= 0 else None
        item, best = points(passage), None
        step = e + 1
        ends = np.flatnonzero(np.append(np.diff(bands) > 4, True))  # bands that are near are aligned together
        for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
            for low in range(int(bands[a]), int(bands[b]) + 1, max(1, DIAGONALS // step)):
                high = min(int(bands[b]), low + max(1, DIAGONALS // step) - 1)
                lo, hi = max(0, low * step - e), (high + 2) * step - 1 + m + e
                found = alignment(item, p[lo:hi], e)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo + found[1], lo + found[2])
        return best

    def regions(self, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``item index, bands`` whose count of q-grams in common reaches the bound; band b has the diagonals from b(e + 1) to (b + 2)(e + 1) - 1."""
        n = self.first[slot + 1] - self.first[slot]
        if n.sum() > PAIRS:
            yield from self.regions_by_item(at, slot)
            return
        ends = np.cumsum(n)
        posting = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.first[slot], n)
        item, diagonal = self.item[posting].astype(np.int64), np.repeat(at.astype(np.int64), n) - self.place[posting]
        band = diagonal // (self.edits[item] + 1)  # also in the band before, which overlaps by half
        shift = int(-band.min()) + 2
        span = int(band.max()) + shift + 2
        key, count = np.unique(np.concatenate([item * span + band + shift, item * span + band + shift - 1]), return_counts=True)
        k = key // span
        key, k = key[count >= self.need[k]], k[count >= self.need[k]]
        for x in np.unique(k).tolist():
            yield x, key[k == x] % span - shift

    def regions_by_item(self, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The same for texts with many pairs of places, item by item in memory that doesn't grow with the pairs.

        At least the bound's number of an item's q-grams must occur in the text at all.
        """
        order = np.argsort(slot, kind="stable")
        at, slot = at[order].astype(np.int64), slot[order]
        distinct, begin = np.unique(slot, return_index=True)
        begin = np.append(begin, len(slot))
        n = self.first[distinct + 1] - self.first[distinct]
        ends = np.cumsum(n)
        posting = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.first[distinct], n)
        item, gram = self.item[posting], np.repeat(np.arange(len(distinct)), n)
        order = np.argsort(item, kind="stable")
        items, from_ = np.unique(item[order], return_index=True)
        from_ = np.append(from_, len(order))
        last = int(at.max())
        for x, a, b in zip(items.tolist(), from_[:-1].tolist(), from_[1:].tolist(), strict=True):
            if b - a < self.need[x]:
                continue
            step = int(self.edits[x]) + 1
            shift = int(self.length[x]) // step + 2
            count = np.zeros(last // step + shift + 3, np.int64)
            edges = (np.arange(len(count) + 1) - shift) * step
            of, place = gram[order[a:b]], self.place[posting[order[a:b]]].astype(np.int64)
            by = np.argsort(of, kind="stable")
            of, place = of[by], place[by]
            cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
            for c, d in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                here, own = at[begin[of[c]] : begin[of[c] + 1]], place[c:d]
                if len(here) > 4 * len(count):  # sorted places are counted between the bands' edges
                    for k in range(0, len(own), max(1, PAIRS // len(edges))):
                        part = own[k : k + max(1, PAIRS // len(edges))]
                        count += np.diff(np.searchsorted(here, part[:, None] + edges), axis=1).sum(axis=0)
                else:
                    for k in range(0, len(own), max(1, PAIRS // len(here))):
                        band = (here - own[k : k + max(1, PAIRS // len(here)), None]) // step + shift
                        count += np.bincount(band.ravel(), minlength=len(count))
            both = count[:-1] + count[1:]
            if len(bands := np.flatnonzero(both >= self.need[x])):
                yield x, bands - shift


class Benchmark:
    """All blocks of an index in a folder."""

    def __init__(self, folder: str, blocks: list[str], rate: float = EDIT_RATE):
        self.blocks = [Index.load(f"{folder}/{b}", rate) for b in blocks]
        self.marks = np.load(f"{folder}/marks.npy", mmap_mode="r") if blocks else None

    def candidates(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the q-grams that the benchmark may have, and the q-grams."""
        p, at, found = points(text), [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
        for k in range(0, len(p) - Q + 1, SLICE):
            g = grams(p[k : k + SLICE + Q - 1])
            hit = np.flatnonzero(marked(self.marks, g))
            at.append((hit + k).astype(np.uint32))
            found.append(g[hit])
        return np.concatenate(at), np.concatenate(found)

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """``item id, edits, start, end`` of each passage found, in the order of place."""
        if not self.blocks:
            return []
        at, gram = self.candidates(text)
        out = [(index.names[k].as_py(), *place) for index in self.blocks for k, *place in index.find(text, at, gram)]
        return sorted(out, key=lambda x: (x[2], x[3], x[1]))


def marked(marks: np.ndarray, g: np.ndarray) -> np.ndarray:
    bit = g >> np.uint64(64 - int(len(marks)).bit_length() - 2)
    return marks[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1)


def _index_rows(folder: str):
    """Writes the passages of a task as blocks of ``BLOCK_CHARS`` characters (or one passage); a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        names, passages, size = [], [], 0

        def block(kind):
            index = Index.of(pa.array(names, kind), passages)
            index.save(f"{folder}/block-{part:05d}-{number:05d}")
            return pa.RecordBatch.from_arrays([pa.array([f"block-{part:05d}-{number:05d}"]), pa.array([len(index.gram)])], ["block", "n_grams"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for name, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                t = normalise(raw)
                if passages and size + len(t) > BLOCK_CHARS:
                    yield block(kind)
                    names, passages, size, number = [], [], 0, number + 1
                if t:
                    names.append(name)
                    passages.append(t)
                    size += len(t)
        if passages:
            yield block(kind)

    return run


def write_index(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[str, list[str]]:
    """The folder of the benchmark's index and its blocks; the driver gets a row for each block."""
    folder = posix(shared_path(benchmark.sparkSession, "benchmark"))
    os.makedirs(folder, exist_ok=True)
    rows = benchmark.select(F.col(item_id).alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = rows.repartition(max(1, -(-chars // BLOCK_CHARS)), F.xxhash64("text")).sortWithinPartitions("text", "id")  # a task that is run again writes the same
    made = sorted(tuple(r) for r in rows.mapInArrow(_index_rows(folder), "block string, n_grams long").collect())
    bits = min(max(int(16 * sum(n for _, n in made)).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
    marks = np.zeros(1 << bits - 3, np.uint8)
    for name, _ in made:
        gram = np.load(f"{folder}/{name}.gram.npy", mmap_mode="r")
        for k in range(0, len(gram), SLICE):
            bit = np.unique(np.asarray(gram[k : k + SLICE]) >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(marks, bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
    write_atomic(f"{folder}/marks.npy", marks)
    return folder, [name for name, _ in made]


def _match_rows(folder: str, blocks: list[str], rate: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(folder, blocks, rate)
        for batch in batches:
            found = [benchmark.find(normalise(raw)) for raw in texts(batch.column(1))]
            lists = [pa.array([[x[k] for x in f] for f in found], pa.list_(kind if k == 0 else pa.int64())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", *LISTS])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """``id_col, items, edits, starts, ends`` of every row: the passages that it holds, in the order of place.

    Texts are compared in the form of ``normalise``; places are characters of it.
    A passage is found where it occurs with at most ``rate`` edits a character; one of
    under ``Q`` characters only as whole words without edits. Of a passage's places the one
    with the fewest edits is told, of such the first. Null and empty texts hold no
    passage; benchmark rows whose id or text is null, or whose text has no letter or
    digit, are never found. Repeated rows are each answered; other columns aren't
    read; no documents give no rows and no benchmark gives rows with empty lists.

    A text takes some 50 times its length in memory, whatever it repeats. Counting takes
    steps in proportion to its length for each passage that shares enough q-grams with it,
    alignment a step for each of the passage's characters and each diagonal of a region.
    The index stays in the folder of ``spark.checkpoint.dir`` for the lazy result.
    """
    folder, blocks = write_index(benchmark, item_id, item_text)
    item_kind = benchmark.schema[item_id].dataType
    lists = ", ".join(f"{c} array<{item_kind.simpleString() if c == 'items' else 'long'}>" for c in LISTS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_match_rows(folder, blocks, rate, to_arrow_type(item_kind)), with_id(docs, id_col, lists))
    return found.select(F.col("id").alias(id_col), *LISTS)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns."""
    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = find_contamination(docs.select(key.alias("row"), F.col(text).alias("text")), benchmark, "row", "text", rate=rate)
    return found.where(F.size("items") == 0).select("row.*")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_contamination(docs, benchmark).select(
        "doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"), "edits", "starts", "ends"
    )
