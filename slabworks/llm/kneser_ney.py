"""LM scoring by an interpolated modified Kneser-Ney model of any order from 2 on.

Tokens and n-grams are counted in Spark: each task hands on sorted, summed arrays, cut
into buckets, and each bucket's arrays are merged by one task. The merged tables are
sorted hash arrays in the shared folder, which every worker maps into memory to score
texts; neither counts nor tables ever pass the driver. It gets a row or two a bucket: the
table's length, its counts of counts, and where its contexts' occurrences should be cut.

A word is known by the XXH64 of its bytes, and its number is its rank in the sorted hash
array; two words collide with odds of n**2 / 2**65. An n-gram is the numbers of the
(n - 1)-grams that begin and end it, its context and its suffix, and its own number is its
rank in the order of these. So n-grams never collide, they are ordered by the hashes of
their words, and an array holds only the suffixes, one context after the other. Texts
begin with as many empty words as a context has.

A bucket is a range of that order with about as many occurrences as any other: a context
that has more than a bucket's is cut along its suffixes. The size of a bucket is fixed, so
their number grows with the input, and with it nothing else that a task holds. Arrays that
are read together lie in one file, which a worker maps once for all tasks, and neighbouring
buckets are joined as long as they have no more than one's occurrences: files, and parts
that one bucket sends another, cost by their number.
"""

from __future__ import annotations

import mmap
import os
import sys
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, posix, shared_path, with_id, write_atomic

ORDER = 3
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line break
SLICE_TOKENS = 1 << 20
FLUSH_KEYS = 1 << 22
BUCKET_BYTES = 16 << 20  # of text, which has about a token for every four bytes
BYTES_PER_TOKEN = 4
OPEN_FILES = 32768  # of the 65,530 maps that Linux gives a process
LARGE = 255
WIDE = 1024
_CODEC = "zstd"


def token_hashes(columns: Iterator[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the tokens of about a million tokens of texts at a time, and where each text ends; null counts as empty."""
    parts, n = [], 0
    for column in columns:
        h, ends = _hashed(column)
        begin = at = 0
        while at < len(ends):
            until = min(len(ends), int(np.searchsorted(ends, begin + SLICE_TOKENS - n)) + 1)
            parts.append((h[begin : ends[until - 1]], ends[at:until] - begin + n))
            n += len(parts[-1][0])
            begin, at = int(ends[until - 1]), until
            if n >= SLICE_TOKENS:
                yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                parts, n = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words are split and told apart by Arrow, so that each is hashed once for a batch."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if wide else pa.binary()).view(pa.large_string() if wide else pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    coded = lists.flatten().dictionary_encode()
    codes, sizes = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    words = coded.dictionary
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    raw, digest, places = data.to_pybytes() if data else b"", xxhash.xxh64_intdigest, at.tolist()
    digests = np.fromiter((digest(raw[a:b]) for a, b in zip(places, places[1:], strict=False)), np.uint64, len(words))
    row = np.repeat(np.arange(len(sizes)), sizes)
    if (np.diff(at) == 0).any():  # what stands before the first and behind the last white space of a text
        there = np.diff(at)[codes] > 0
        codes, row = codes[there], row[there]
        sizes = np.bincount(row, minlength=len(sizes))
    h = np.full(len(codes) + len(sizes), END)
    h[np.arange(len(codes)) + row] = digests[codes]
    return h, np.cumsum(sizes + 1)


# Arrays as bytes: what is sent between tasks.


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed; the first is sorted and goes as differences."""
    codec, head = pa.Codec(_CODEC, compression_level=1), arrays[0].astype(np.uint64)
    out = [np.array([len(head), head[0] if len(head) else 0], np.uint64).tobytes()]
    for x in (np.diff(head, prepend=head[:1]), *arrays[1:]):
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
        body = codec.compress(planes.tobytes(), asbytes=True)
        out += [np.array([width, len(body)], np.uint64).tobytes(), body]
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    codec = pa.Codec(_CODEC)
    n, first = np.frombuffer(raw, np.uint64, 2).tolist()
    out, at = [], 16
    while at < len(raw):
        width, size = np.frombuffer(raw, np.uint64, 2, at).tolist()
        planes = np.frombuffer(codec.decompress(raw[at + 16 : at + 16 + size], width * n, asbytes=True), np.uint8).reshape(width, n)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = planes.T
        out.append(x.view("<u8").reshape(-1))
        at += 16 + size
    out[0] = np.cumsum(out[0], dtype=np.uint64) + np.uint64(first)
    return out


# Sums.


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in any order, and of each value its place among them."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of the counts (1 each if not given) of each."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def grouped(c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts pairs, where each distinct pair begins in it, and the distinct pairs."""
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), c, s
    bits = int(s.max()).bit_length()
    order = np.argsort(c << bits | s) if int(c.max()).bit_length() + bits < 64 else np.lexsort((s, c))
    c, s = c[order], s[order]
    first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])))
    return order, first, c[first], s[first]


def summed_pairs(c: np.ndarray, s: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if counts is None and len(c) and int(c.max()).bit_length() + (bits := int(s.max()).bit_length()) < 64:
        keys = np.sort(c << bits | s)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        c = keys[first] >> bits
        return c, keys[first] ^ c << bits, np.diff(np.append(first, len(keys)))
    order, first, c, s = grouped(c, s)
    if not len(order):
        return c, s, np.zeros(0, np.int64)
    return c, s, np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)


def summed_parts(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """``summed`` or ``summed_pairs`` of all parts, which have counts; the list is emptied, so that little is held twice."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    parts.clear()
    if len(columns) == 2:
        return summed(*columns)
    c, s, n = columns
    del columns
    if not len(c):
        return c, s, n
    least, bits = int(c.min()), int(s.max()).bit_length()
    if int(c.max() - least).bit_length() + bits > 63:
        return summed_pairs(c, s, n)
    c -= least
    c <<= bits
    c |= s
    del s
    order = np.argsort(c)
    c, n = c[order], n[order]
    del order
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    c, n = c[first], np.add.reduceat(n, first)
    s = c & (1 << bits) - 1
    c >>= bits
    c += least
    return c, s, n


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c >= 3).sum())]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more, from counts of counts 1 to 4."""
    n1, n2, n3, n4 = n[:4]
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    out = [k - (k + 1) * y * b / a if a else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(out, 1))


# Files of a model: arrays by name and bucket, counts in a byte each but for the large ones.


class Files:
    """Arrays of a model, mapped on first use; a folder of a model is never changed once read.

    ``OPEN_FILES`` files stay mapped. Beyond that the latest one makes way, as files are read round and round in one order.
    """

    def __init__(self, folder: str):
        self.folder, self.files = folder, OrderedDict()

    def all(self, name: str, bucket: int) -> list[np.ndarray]:
        """The arrays of a file, none if it isn't there."""
        key = name, bucket
        if key in self.files:
            self.files.move_to_end(key)
            return self.files[key]
        path = f"{self.folder}/{name}.{bucket}.npy"
        if not os.path.exists(path):
            return []
        if len(self.files) >= OPEN_FILES:
            self.files.popitem()
        self.files[key] = _mapped(path)
        return self.files[key]

    def __call__(self, name: str, bucket: int) -> np.ndarray:
        return next(iter(self.all(name, bucket)), np.zeros(0, np.int64))

    def counts(self, name: str, bucket: int, at: np.ndarray, column: int = 0) -> np.ndarray:
        small, known = self.all(name, bucket)[2 * column : 2 * column + 2]
        out = small[at].astype(np.int64)
        large = np.flatnonzero(out == LARGE)
        if len(large):
            known = known.reshape(2, -1)
            out[large] = known[1][np.searchsorted(known[0], at[large])]
        return out

    def write(self, name: str, bucket: int, *arrays: np.ndarray) -> None:
        """One file of whole words of 8 bytes: how many arrays there are, the kind and size of each, then their cells."""
        head = np.array([len(arrays), *(x for a in arrays for x in (_KINDS.index(a.dtype), a.size))], np.int64)
        cells = [head, *(np.append(raw := np.ascontiguousarray(a).reshape(-1).view(np.uint8), np.zeros(-len(raw) % 8, np.uint8)).view(np.int64) for a in arrays)]
        write_atomic(f"{self.folder}/{name}.{bucket}.npy", np.concatenate(cells))

    def write_counts(self, name: str, bucket: int, *columns: np.ndarray) -> None:
        arrays = []
        for counts in columns:
            large = np.flatnonzero(counts >= LARGE)
            arrays += [np.minimum(counts, LARGE).astype(np.uint8), np.stack([large, counts[large]]).astype(np.int64)]
        self.write(name, bucket, *arrays)


_KINDS = [np.dtype(x) for x in (np.uint8, np.uint32, np.int64, np.uint64)]
_NO_FD = {"trackfd": False} if sys.version_info >= (3, 13) else {}
_FILES: dict[str, Files] = {}


def _mapped(path: str) -> list[np.ndarray]:
    with open(path, "rb") as f:
        raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_NO_FD)
    begin = 10 + int.from_bytes(raw[8:10], "little")  # behind what np.save puts before an array
    n = int(np.frombuffer(raw, np.int64, 1, begin)[0])
    out, at = [], begin + 8 + 16 * n
    for kind, size in np.frombuffer(raw, np.int64, 2 * n, begin + 8).reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, _KINDS[kind], size, at))
        at += -(-size * _KINDS[kind].itemsize // 8) * 8
    return out


def files_of(folder: str) -> Files:
    """The files of a model, which stay mapped for the tasks that follow in this process until another model is read."""
    if folder not in _FILES:
        _FILES.clear()
        _FILES[folder] = Files(folder)
    return _FILES[folder]


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``value, from, to`` of each run."""
    at = np.append(np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])), len(sorted_values)) if len(sorted_values) else np.zeros(1, np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(sorted_values[a]), a, b


def bisect(array: np.ndarray, lo: np.ndarray, hi: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each value its place between ``lo`` and ``hi``, where the array is sorted; -1 if it isn't there. Ranges of more than ``WIDE`` cells that begin alike end alike."""
    out, size, values = np.full(len(lo), -1, np.int64), hi - lo, values.astype(array.dtype)
    for least, most in ((1, 8), (9, WIDE)):
        if len(at := np.flatnonzero((size >= least) & (size <= most))):
            place, n, v = lo[at], size[at], values[at]
            for _ in range((int(n.max()) - 1).bit_length()):
                half = n >> 1
                place += half * (array[place + half - 1] < v)
                n -= half
            out[at] = np.where(array[place] == v, place, -1)
    wide = np.flatnonzero(size > WIDE)
    for begin, a, b in _runs(lo[wide]):
        at = wide[a:b]
        part = array[begin : int(hi[at[0]])]
        place = np.minimum(np.searchsorted(part, values[at]), len(part) - 1)
        out[at] = np.where(part[place] == values[at], place + begin, -1)
    return out


@dataclass
class Level:
    """N-grams of one length: where buckets begin in the order of context and suffix, and which numbers they have."""

    k: int
    contexts: np.ndarray  # where buckets begin: the context, and the suffix in it
    suffixes: np.ndarray
    base: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # the first number of each bucket, then the number of all
    shared: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # contexts that are cut, with their sums over buckets
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))
    d: tuple[float, float, float] = (0.5, 0.5, 0.5)

    @property
    def n(self) -> int:
        return int(self.base[-1])

    def cuts(self, c: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Where each bucket begins in sorted pairs, and their number."""
        lo = np.searchsorted(c, self.contexts)
        for j in np.flatnonzero(self.suffixes).tolist():
            hi = np.searchsorted(c, self.contexts[j], "right")
            lo[j] += np.searchsorted(s[lo[j] : hi], self.suffixes[j])
        return np.append(lo, len(c))

    def buckets(self, c: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, int, int]]:
        at = self.cuts(c, s)
        for j in np.flatnonzero(np.diff(at)).tolist():
            yield j, int(at[j]), int(at[j + 1])

    def n_contexts(self, j: int, n_before: int) -> int:
        """How many contexts bucket ``j`` has a part of; ``n_before`` is the last, that of texts' beginnings."""
        if j + 1 == len(self.contexts):
            return n_before - int(self.contexts[j]) + 1
        return int(self.contexts[j + 1] - self.contexts[j]) + int(self.suffixes[j + 1] > 0)

    def look_up(self, files: Files, c: np.ndarray, s: np.ndarray, counts: bool = False) -> tuple[np.ndarray, ...]:
        """The numbers of n-grams of these contexts and suffixes, -1 for one that is absent (or its suffix is -1).

        With ``counts`` also the n-grams' counts, their contexts' sums, and what discounts take off these.
        """
        order, first, dc, ds = grouped(c, np.maximum(s, 0))
        numbers, values, total, off = np.full(len(dc), -1, np.int64), np.zeros(len(dc), np.int64), np.zeros(len(dc), np.int64), np.zeros(len(dc))
        for j, a, b in self.buckets(dc, ds):
            arrays = files.all(f"grams{self.k}", j)
            if not arrays:
                continue
            at = dc[a:b] - self.contexts[j]
            lo, hi = arrays[0][at].astype(np.int64), arrays[0][at + 1].astype(np.int64)
            place = bisect(arrays[1], lo, hi, ds[a:b])
            there = place >= 0
            numbers[a:b] = np.where(there, place + self.base[j], -1)
            if counts:
                name = f"sums{self.k}"
                values[a:b][there] = files.counts(name, j, place[there])
                total[a:b], one, two = (files.counts(name, j, at, column) for column in (1, 2, 3))
                off[a:b] = self.off(one, two, hi - lo - one - two)
        if counts and len(self.shared):
            at = np.minimum(np.searchsorted(self.shared, dc), len(self.shared) - 1)
            cut = np.flatnonzero(self.shared[at] == dc)
            total[cut], *rest = self.sums[at[cut]].T
            off[cut] = self.off(*rest)
        del dc, ds
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        del order, first
        known = s >= 0
        numbers = np.where(known, numbers[back], -1)
        return (numbers, np.where(known, values[back], 0), total[back], off[back]) if counts else (numbers,)

    def off(self, one: np.ndarray, two: np.ndarray, more: np.ndarray) -> np.ndarray:
        return one * self.d[0] + two * self.d[1] + more * self.d[2]


def _write_sums(files: Files, k: int, j: int, first: np.ndarray, counts: np.ndarray, cut: tuple[bool, bool]) -> np.ndarray:
    """Writes a bucket's counts and what its contexts add up to: sum, counts of 1 and of 2; returns those of its first and last context where these are cut: ``place, total, 1, 2, 3 or more``."""
    at, size = first[:-1][np.diff(first) > 0], np.diff(first)
    sums = np.zeros((len(size), 3), np.int64)
    if len(at):
        for column, x in enumerate((counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64))):
            sums[size > 0, column] = np.add.reduceat(x, at)
    files.write_counts(f"sums{k}", j, counts, *sums.T)
    edges = sorted({place for place, is_cut in zip((0, len(size) - 1), cut, strict=True) if is_cut})
    return np.array([[e, *sums[e], size[e] - sums[e, 1] - sums[e, 2]] for e in edges], np.int64).reshape(-1, 5)


def next_cuts(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the contexts of the next length should be cut, by their occurrences: ``place, share of the place's suffixes before it``.

    A bucket's first context begins a bucket, and then every ``most`` occurrences do,
    within a context only where it has more than that by itself.
    """
    cum = np.cumsum(counts)
    marks = np.arange(most, int(cum[-1]) if len(cum) else 0, most)
    at = np.searchsorted(cum, marks, "right")
    share = np.where(counts[at] > most, (marks - (cum[at] - counts[at])) / counts[at], 0.0)
    places, shares = np.append(0, at), np.append(0.0, share)
    keep = np.append(True, (np.diff(places) > 0) | (np.diff(shares) > 0))
    return places[keep], shares[keep]


def _cuts(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``next_cuts``, and the occurrences before each cut, then those of all."""
    places, shares = next_cuts(counts, most)
    cum = np.append(0, np.cumsum(counts))
    return places, shares, np.append(cum[places] + (shares * np.append(counts, 0)[places]).astype(np.int64), cum[-1])


def _fewer(cuts: list[tuple], most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Those cuts that are needed for a bucket to have ``most`` occurrences, where neighbours have fewer."""
    out, held = [], 0
    for base, places, shares, at in cuts:
        keep = np.zeros(len(places), bool)
        for k, n in enumerate(np.diff(at).tolist()):
            held += n
            if held > most:
                keep[k], held = True, n
        out.append((base, places[keep], shares[keep]))
    return out


def _groups(counts: list[int], most: int) -> np.ndarray:
    """Where groups of neighbours begin that have ``most`` together, or are one."""
    begins, held = [0], 0
    for k, n in enumerate(counts):
        held += n
        if held > most and k:
            begins.append(k)
            held = n
    return np.array(begins)


@dataclass
class Model:
    """What workers need besides the files; ``base`` has the first rank of each bucket of words."""

    folder: str
    bits: int
    base: np.ndarray
    n_tokens: int
    n_texts: int
    d1: tuple[float, float, float] = (0.5, 0.5, 0.5)
    rest: float = 1.0
    levels: list[Level] = field(default_factory=list)

    @property
    def order(self) -> int:
        return len(self.levels) + 1

    @property
    def n_words(self) -> int:
        return int(self.base[-1])

    def words(self, files: Files, hashes: np.ndarray, counts: bool = False) -> tuple[np.ndarray, ...]:
        """Numbers of the words of these hashes, -1 for one that is absent; and their counts and the number of words before them."""
        keys, codes = distinct(hashes)
        order = np.argsort(keys)
        keys, numbers, found = keys[order], np.full(len(keys), -1, np.int64), np.zeros((2, len(keys)), np.int64)
        for j, a, b in _runs((keys >> np.uint64(64 - self.bits)).astype(np.int64)):
            have = files("word", j)
            if not len(have):
                continue
            at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
            same = have[at] == keys[a:b]
            numbers[a:b][same] = self.base[j] + at[same]
            if counts:
                for column, name in enumerate(("count1", "before1")):
                    found[column, a:b][same] = files.counts(name, j, at[same])
        back = np.empty(len(keys), np.int64)
        back[order] = np.arange(len(keys))
        back = back[codes]
        return numbers[back], *(found[:, back] if counts else ())

    def context(self, level: Level, numbers: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The context of each token: the (k - 1)-gram that ends before it, or that of a text's beginning."""
        first = self.n_before(level)
        context = np.append(first, numbers[:-1])
        context[ends[:-1]] = first
        return context

    def n_before(self, level: Level) -> int:
        return self.n_words if level.k == 2 else self.levels[level.k - 3].n

    def pairs(self, files: Files, hashes: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Context and suffix of the k-gram that ends at each token of texts that were counted."""
        numbers = self.words(files, hashes)[0]
        for level in self.levels[: k - 2]:
            numbers = level.look_up(files, self.context(level, numbers, ends), numbers)[0]
        return self.context(self.levels[k - 2], numbers, ends), numbers


def _off(d: tuple[float, float, float], c: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


_PART = "bucket int, data binary"
_ROW = "bucket int, kind int, data binary"


def _counted(slices: Iterator[tuple], add, cut) -> Iterator[pa.RecordBatch]:
    """Sums keys and hands them on by bucket; holds ``FLUSH_KEYS`` of them or so."""
    held, size = [], 0

    def rows(arrays: tuple) -> Iterator[pa.RecordBatch]:
        spans = list(cut(*arrays))
        for k in range(0, len(spans), 256):
            some = spans[k : k + 256]
            yield pa.RecordBatch.from_arrays([pa.array([j for j, _, _ in some], pa.int32()), pa.array([packed(*(x[a:b] for x in arrays)) for _, a, b in some], pa.binary())], ["bucket", "data"])

    for keys in slices:
        held.append(add(*keys))
        size += len(held[-1][0])
        if size > FLUSH_KEYS:
            held = [summed_parts(held)]
            size = len(held[0][0])
            if size > FLUSH_KEYS // 2:
                yield from rows(held[0])
                held, size = [], 0
    if held:
        held = [summed_parts(held)]
        if len(held[0][0]):
            yield from rows(held[0])


def _gathered(table: pa.Table, kind=np.int64) -> tuple[np.ndarray, ...]:
    """The arrays of a bucket from all tasks, put together and summed; ``kind`` is the first one's, the others are signed."""
    return summed_parts([(x[0].view(kind), *(y.view(np.int64) for y in x[1:])) for x in (unpacked(y.as_buffer()) for y in table.column("data"))])


def _row(bucket: int, kind: int, *arrays: np.ndarray) -> pa.Table:
    """A row to the driver, or to a later bucket: arrays of 64-bit values with their lengths."""
    raw = b"".join(np.int64(len(a.reshape(-1))).tobytes() + np.ascontiguousarray(a).astype(a.dtype if a.dtype == np.float64 else np.int64).tobytes() for a in arrays)
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "kind": pa.array([kind], pa.int32()), "data": pa.array([raw], pa.binary())})


def _arrays(raw: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + 8 * n
    return out


def _level(k: int, cuts: list[tuple[int, np.ndarray, np.ndarray]], n_before: int, n_texts: int, most: int, range_of) -> Level:
    """Buckets of the k-grams from the cuts of their contexts; ``range_of`` gives the suffixes that a context can have."""
    at, share = (np.concatenate([*x, np.zeros(0)]) for x in (zip(*((base + places, shares) for base, places, shares in cuts), strict=True) if cuts else ((), ())))
    starts = np.arange(0, max(1, n_texts), most) / max(1, n_texts)  # texts' beginnings are a context as well
    at, share = np.append(at, np.full(len(starts), n_before)).astype(np.int64), np.append(share, starts)
    suffix = np.zeros(len(at), np.int64)
    for j in np.flatnonzero(share).tolist():
        lo, hi = range_of(int(at[j]))
        suffix[j] = lo + int(share[j] * (hi - lo))
    pairs = sorted(set(zip(at.tolist(), suffix.tolist(), strict=True)) | {(0, 0)})  # suffix 0: from the context's beginning on
    return Level(k, np.array([c for c, _ in pairs], np.int64), np.array([s for _, s in pairs], np.int64))


def train(docs: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES, order: int = ORDER) -> Model:
    """Count ``docs`` and write the files of a model; a null or empty text is its end alone, repeated rows count as often as they stand.

    A bucket has the n-grams of about ``bucket_bytes`` of text. A text of any length is
    read whole by one task, at some 100 bytes a token.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(1, int(size // bucket_bytes).bit_length())
    most = max(1, bucket_bytes // BYTES_PER_TOKEN)
    folder = posix(shared_path(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)

    def merge(sent: DataFrame, work, tasks: int) -> DataFrame:
        return sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(work, _ROW)

    # Words.

    def tokens(batches):
        def cut(keys, _):
            return _runs((keys >> np.uint64(64 - bits)).astype(np.int64))

        return _counted(((h,) for h, _ in token_hashes(b.column(0) for b in batches)), summed, cut)

    def words(table: pa.Table) -> pa.Table:
        j, files = table.column("bucket")[0].as_py(), Files(folder)
        keys, counts = _gathered(table, np.uint64)
        files.write("word", j, keys)
        files.write_counts("count1", j, counts)
        return _row(j, 0, np.array([len(keys), counts.sum(), counts[keys == END].sum()]), *_cuts(counts, most))

    found = {r["bucket"]: _arrays(r["data"], np.int64, np.int64, np.float64, np.int64) for r in merge(rows.mapInArrow(tokens, _PART), words, 1 << bits).collect()}
    sizes, occurrences = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for j, (about, *_) in found.items():
        sizes[j], occurrences[j], _ = about
    model = Model(folder, bits, np.append(0, np.cumsum(sizes)), sum(int(a[1]) for a, *_ in found.values()), sum(int(a[2]) for a, *_ in found.values()))
    if not model.n_tokens:
        return model
    cuts = [(int(model.base[j]), *x) for j, (_, *x) in sorted(found.items())]

    def count(k: int, cuts: list) -> list:
        """Counts the k-grams and finishes the level below; returns the cuts of the next."""
        n_before, top, lower = model.n_before(Level(k, *[np.zeros(1, np.int64)] * 2)), k == order, model.levels[-1] if k > 2 else None
        files = files_of(folder)

        def range_of(c: int) -> tuple[int, int]:
            """Numbers of the (k - 1)-grams that can end a k-gram of context ``c``: those that begin with its last k - 2 words."""
            if k == 2 or c == n_before:
                return 0, n_before
            return _followers(files, model, k - 1, _suffix_of(files, model.levels[k - 3], c))

        level = _level(k, _fewer(cuts, most), n_before, model.n_texts, most, range_of)
        model.levels.append(level)
        of_lower = model.base if lower is None else lower.base
        groups = _groups(occurrences.tolist(), most) if lower is None else np.arange(len(of_lower) - 1)  # of buckets below, each a task's

        def grams(batches):
            files = files_of(folder)
            slices = (model.pairs(files, h, ends, k) for h, ends in token_hashes(b.column(0) for b in batches))
            return _counted(slices, summed_pairs, lambda c, s, _: level.buckets(c, s))

        def table_of(table: pa.Table) -> pa.Table:
            """Writes a bucket's n-grams; returns how many end in each (k - 1)-gram, by the groups of these, and what the driver needs."""
            j, files = table.column("bucket")[0].as_py(), Files(folder)
            c, s, counts = _gathered(table)
            first = np.searchsorted(c, level.contexts[j] + np.arange(level.n_contexts(j, n_before) + 1)).astype(np.uint32)
            files.write(f"grams{k}", j, first, s.astype(np.uint32 if n_before < 1 << 32 else np.int64))
            edges, of = np.zeros((0, 5), np.int64), np.zeros(5, np.int64)
            if top:
                edges, of = _write_sums(files, k, j, first.astype(np.int64), counts, _is_cut(level, j)), np.array(counts_of_counts(counts))
            own = _row(-1, j, np.array([len(c)]), of, edges, *_cuts(counts, most))
            del c, first, counts
            ends, n = summed(s)
            spans = list(_runs(np.searchsorted(of_lower[groups], ends, "right") - 1))
            parts = [pa.array([g for g, _, _ in spans], pa.int32()), pa.array([j] * len(spans), pa.int32()), pa.array([packed(ends[a:b], n[a:b]) for _, a, b in spans], pa.binary())]
            return pa.concat_tables([own, pa.Table.from_arrays(parts, names=own.column_names)])

        def before(table: pa.Table) -> pa.Table:
            """Writes by how many n-grams each (k - 1)-gram of a group of buckets is ended; what the driver needs is passed on."""
            g, files = table.column("bucket")[0].as_py(), Files(folder)
            if g < 0:
                return table
            ends, n = _gathered(table)
            begin, end = int(groups[g]), int(groups[g + 1]) if g + 1 < len(groups) else len(of_lower) - 1
            of, edges = np.zeros(5, np.int64), np.zeros((0, 5), np.int64)
            for j, a, b in _runs(np.searchsorted(of_lower[begin : end + 1], ends, "right") - 1 + begin):
                counts = np.zeros(int(of_lower[j + 1] - of_lower[j]), np.int64)
                counts[ends[a:b] - of_lower[j]] = n[a:b]
                of += counts_of_counts(counts)
                if lower is None:
                    files.write_counts("before1", j, counts)
                else:
                    edges = _write_sums(files, k - 1, j, files(f"grams{k - 1}", j).astype(np.int64), counts, _is_cut(lower, j))
            return _row(-2, g, of, edges)

        sent = merge(rows.mapInArrow(grams, _PART), table_of, len(level.contexts))
        found = merge(sent, before, len(groups)).collect()  # two rows for each bucket
        own = {r["kind"]: _arrays(r["data"], np.int64, np.int64, np.int64, np.int64, np.float64, np.int64) for r in found if r["bucket"] == -1}
        sizes = np.zeros(len(level.contexts), np.int64)
        for j, (about, *_) in own.items():
            sizes[j] = about[0]
        level.base = np.append(0, np.cumsum(sizes))
        of_before = {r["kind"]: _arrays(r["data"], np.int64, np.int64) for r in found if r["bucket"] == -2}
        n = np.sum([x for x, _ in of_before.values()], axis=0).tolist()
        if lower is None:
            model.d1 = discounts(n)
            model.rest = (model.d1[0] * n[0] + model.d1[1] * n[1] + model.d1[2] * n[4]) / level.n
        else:
            _close(lower, n, [(j, x) for j, (_, x) in of_before.items()])
        if top:
            _close(level, np.sum([x for _, x, *_ in own.values()], axis=0).tolist(), [(j, x) for j, (_, _, x, *_) in own.items()])
        return [(int(level.base[j]), *x) for j, (_, _, _, *x) in sorted(own.items())]

    for k in range(2, order + 1):
        cuts = count(k, cuts)
    return model


def _is_cut(level: Level, j: int) -> tuple[bool, bool]:
    """If bucket ``j`` has only a part of its first and of its last context."""
    return bool(level.suffixes[j] > 0) or (j + 1 < len(level.contexts) and level.contexts[j + 1] == level.contexts[j]), j + 1 < len(level.contexts) and bool(level.suffixes[j + 1] > 0)


def _close(level: Level, n: list[int], edges: list[tuple[int, np.ndarray]]) -> None:
    """Discounts of a level, and the sums of the contexts that buckets share."""
    level.d = discounts(n)
    sums: dict[int, np.ndarray] = {}
    for j, rows in edges:
        for place, *x in rows.reshape(-1, 5).tolist():
            c = int(level.contexts[j]) + place
            sums[c] = sums.get(c, np.zeros(4, np.int64)) + np.array(x)
    level.shared = np.array(sorted(sums), np.int64)
    level.sums = np.array([sums[c] for c in sorted(sums)], np.int64).reshape(-1, 4)


def _suffix_of(files: Files, level: Level, number: int) -> int:
    """The suffix of the n-gram of this number."""
    j = int(np.searchsorted(level.base, number, "right")) - 1
    return int(files.all(f"grams{level.k}", j)[1][number - level.base[j]])


def _followers(files: Files, model: Model, k: int, c: int) -> tuple[int, int]:
    """The numbers of the k-grams of context ``c``: the first, and the one after the last."""
    level = model.levels[k - 2]
    lo, hi = [], []
    for j in range(max(0, int(np.searchsorted(level.contexts, c)) - 1), int(np.searchsorted(level.contexts, c, "right"))):
        place = c - int(level.contexts[j])
        if 0 <= place < level.n_contexts(j, model.n_before(level)) and len(first := files(f"grams{k}", j)):
            lo.append(int(level.base[j] + first[place]))
            hi.append(int(level.base[j] + first[place + 1]))
    return (min(lo), max(hi)) if lo else (0, level.n)


def _score_rows(model: Model):
    def scores(files: Files, h: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        numbers, count, before = model.words(files, h, counts=True)
        known = numbers >= 0
        base = np.log10((count + 1) / (model.n_tokens + model.n_words + 1))
        del h, count
        p = np.full(len(known), model.rest / (model.n_words + 1))
        if model.levels:
            p += np.maximum(before - _off(model.d1, before), 0) / model.levels[0].n
        del before
        for level in model.levels:
            context = model.context(level, numbers, ends)
            at = np.flatnonzero(context >= 0)
            found, value, total, off = level.look_up(files, context[at], numbers[at], counts=True)
            p[at] = (np.maximum(value - _off(level.d, value), 0) + off * p[at]) / total
            numbers = np.full(len(known), -1, np.int64)
            numbers[at] = found
            del found, value, total, off
        starts = np.append(0, ends[:-1])
        return [np.add.reduceat(x, starts) for x in (np.ones(len(known), np.int64), known.astype(np.int64), base, np.log10(p))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, ids = files_of(model.folder), []

        def columns() -> Iterator[pa.Array]:
            for batch in batches:
                ids.append(batch.column(0))
                yield batch.column(1)

        for h, ends in token_hashes(columns()):
            own = pa.concat_arrays(ids)
            ids[:] = [own.slice(len(ends))]
            cols = [pa.array(x) for x in scores(files, h, ends)]
            total = pa.array(np.full(len(ends), model.n_tokens, np.int64))
            yield pa.RecordBatch.from_arrays([own.slice(0, len(ends)), *cols[:2], total, *cols[2:]], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every whole text.

    Scores are log10 probabilities of the text's tokens and its end, under add-one
    unigrams and under the model. A null text counts as empty, which is its end alone.
    A model of no texts gives every token probability 1. Ids may be null or repeat, and
    texts that agree have the same score; other columns aren't read; no rows give no
    rows. A text of any length takes some 200 bytes a token. The model's files stay in the
    folder of ``spark.checkpoint.dir`` for the lazy result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(_score_rows(model), with_id(docs, id_col, "n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("id", id_col)


def op6_lm_score(spark, sf_dir: str, order: int = ORDER) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold(F.col("doc_id"), 7) == 2
    return score(docs, train(docs.where(~held_out), order=order)).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
