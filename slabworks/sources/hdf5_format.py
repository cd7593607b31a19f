"""HDF5 files by their published format, in Python and numpy: what array files have in them, and no more.

Read are superblocks 0 to 3, object headers 1 and 2, groups as symbol tables or links
(in the header or in a fractal heap), fixed- and floating-point numbers, text and
references, compact, contiguous and chunked storage (B-trees, single and implicit
chunks), and the filters deflate, shuffle and Fletcher's checksum. Anything else is
``Unsupported``. A slab reads only the runs or chunks that it meets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

# Fixed values of the format: signatures, and message types.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, LINK_INFO, DATATYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS, ATTRIBUTE_INFO = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3


class Unsupported(ValueError):
    """A part of the format that isn't read here, or no file of this format."""


class Bytes:
    """A place in some bytes, read on from."""

    def __init__(self, raw: bytes, at: int = 0, widths: tuple[int, int] = (8, 8)):
        self.raw, self.at, self.widths = raw, at, widths

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.raw):
            raise Unsupported("the bytes end too early")
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def numbers(self, count: int, n: int) -> tuple[int, ...]:
        return tuple(self.number(n) for _ in range(count))

    def address(self) -> int | None:
        """An address; None where there is none."""
        raw = self.take(self.widths[0])
        return None if raw == b"\xff" * len(raw) else int.from_bytes(raw, "little")

    def length(self) -> int:
        return self.number(self.widths[1])

    def expect(self, mark: bytes) -> None:
        if self.take(len(mark)) != mark:
            raise Unsupported(f"{mark!r} is missing")

    def name(self, n: int) -> str:
        return self.take(n).partition(b"\0")[0].decode()


@dataclass(frozen=True)
class Kind:
    """A datatype: ``number`` and ``text`` have a numpy type, ``reference`` and ``list`` what they lead to; ``other`` isn't read."""

    what: str
    size: int
    dtype: np.dtype | None = None
    of: Kind | None = None


def kind(b: Bytes) -> Kind:
    head, bits, size = b.number(1), b.take(3), b.number(4)
    order = ">" if bits[0] & 1 else "<"
    match head & 15:
        case 0:
            _, precision = b.numbers(2, 2)
            sign = "i" if bits[0] & 8 else "u"
            return Kind("number", size, np.dtype(f"{order}{sign}{size}")) if size in (1, 2, 4, 8) and precision == 8 * size else Kind("other", size)
        case 1:
            b.take(12)
            return Kind("number", size, np.dtype(f"{order}f{size}")) if size in (4, 8) and not bits[0] & 64 else Kind("other", size)
        case 3:
            return Kind("text", size, np.dtype(f"S{size}"))
        case 7:
            return Kind("reference" if bits[0] & 15 == 0 else "other", size)
        case 9:
            inner = kind(b)
            return Kind("list text" if bits[0] & 15 == 1 else "list", size, of=inner)
    return Kind("other", size)


def dataspace(b: Bytes) -> tuple[int, ...] | None:
    """The shape; None for no elements at all."""
    version, rank, flags = b.numbers(3, 1)
    if version == 1:
        b.take(5)
    elif version != 2:
        raise Unsupported(f"dataspace {version}")
    elif b.number(1) == 2:
        return None
    return tuple(b.length() for _ in range(rank))


@dataclass
class Object:
    """A group or a dataset: its messages by type."""

    file: File
    messages: list[tuple[int, Bytes]] = field(default_factory=list)

    def first(self, message: int) -> Bytes | None:
        found = next((m for t, m in self.messages if t == message), None)
        return found and Bytes(found.raw, found.at, found.widths)

    def all(self, message: int) -> Iterator[Bytes]:
        return (Bytes(m.raw, m.at, m.widths) for t, m in self.messages if t == message)

    @cached_property
    def attributes(self) -> dict[str, object]:
        """Values: numbers as arrays, text as bytes (or a list of them), lists of references as addresses; None for what isn't read."""
        raw = list(self.all(ATTRIBUTE))
        if info := self.first(ATTRIBUTE_INFO):
            info.take(1)
            flags = info.number(1)
            info.take(2 * (flags & 1))
            heap, index = info.address(), info.address()
            if heap is not None:
                raw += [b for _, b in sorted(((order, b) for order, b in self.file.dense(heap, index)), key=lambda x: x[0])]
        return dict(map(self.file.attribute, raw))

    @cached_property
    def links(self) -> dict[str, int]:
        """Address of each member of a group, in the order of creation where it is known, else of the name."""
        if table := self.first(SYMBOLS):
            tree, heap = table.address(), table.address()
            return dict(self.file.symbols(tree, self.file.local_heap(heap)))
        found = [self.file.link(m) for m in self.all(LINK)]
        if info := self.first(LINK_INFO):
            info.take(1)
            info.take(8 * (info.number(1) & 1))
            heap, index = info.address(), info.address()
            if heap is not None:
                found += [self.file.link(b) for _, b in self.file.dense(heap, index)]
        found.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        return {name: at for _, name, at in found if at is not None}

    @cached_property
    def shape(self) -> tuple[int, ...] | None:
        space = self.first(DATASPACE)
        return space and dataspace(space)

    @property
    def is_dataset(self) -> bool:
        return self.first(LAYOUT) is not None

    @cached_property
    def kind(self) -> Kind:
        return kind(self.first(DATATYPE))

    @cached_property
    def fill(self) -> bytes:
        """The bytes of an element that was never written."""
        b = self.first(FILL)
        if b:
            version = b.number(1)
            if version < 3:
                b.take(2)
                known = b.number(1)
            else:
                known = b.number(1) & 32
            if known and (size := b.number(4)) == self.kind.size:
                return b.take(size)
        return b"\0" * self.kind.size

    @cached_property
    def filters(self) -> list[int]:
        b, out = self.first(FILTERS), []
        if b:
            version, n = b.numbers(2, 1)
            b.take(6 * (version == 1))
            for _ in range(n):
                number = b.number(2)
                size = b.number(2) if version == 1 or number >= 256 else 0
                _, values = b.numbers(2, 2)
                b.take(-(-size // 8) * 8 if version == 1 else size)
                b.take(4 * (values + (version == 1 and values % 2)))
                out.append(number)
        return out

    @cached_property
    def layout(self) -> tuple:
        """``("compact", bytes)``, ``("contiguous", address)`` or ``("chunks", how, address, chunk shape, filtered size, mask)``."""
        b = self.first(LAYOUT)
        version, how = b.numbers(2, 1)
        if version not in (3, 4):
            raise Unsupported(f"layout {version}")
        if how == 0:
            return "compact", b.take(b.number(2))
        if how == 1:
            return "contiguous", b.address()
        if how != 2:
            raise Unsupported(f"layout class {how}")
        if version == 3:
            rank = b.number(1)
            address = b.address()
            return "chunks", "tree", address, b.numbers(rank, 4)[:-1], 0, 0
        flags, rank, width = b.numbers(3, 1)
        chunk, index = b.numbers(rank, width)[:-1], b.number(1)
        if index == 1:
            size, mask = (b.length(), b.number(4)) if flags & 2 else (0, 0)
            return "chunks", "single", b.address(), chunk, size, mask
        if index == 2:
            return "chunks", "implicit", b.address(), chunk, 0, 0
        raise Unsupported(f"chunk index {index}")

    @property
    def stored(self) -> bool:
        return self.layout[0] == "compact" or self.layout[1 if self.layout[0] == "contiguous" else 2] is not None

    def chunks(self, starts: tuple[int, ...], counts: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """``offsets, address, size, mask`` of the chunks that a box may meet."""
        _, how, address, chunk, size, mask = self.layout
        whole = int(np.prod(chunk, dtype=np.int64)) * self.kind.size
        if how == "tree":
            yield from self.file.chunk_tree(address, len(chunk), starts[0], starts[0] + counts[0], chunk[0])
        elif how == "single":
            yield (0,) * len(chunk), address, size or whole, mask
        else:
            grid = tuple(-(-n // c) for n, c in zip(self.shape, chunk, strict=True))
            for k, at in enumerate(np.ndindex(*grid)):
                yield tuple(i * c for i, c in zip(at, chunk, strict=True)), address + k * whole, whole, 0

    def unfiltered(self, raw: bytes, mask: int) -> bytes:
        for place, number in reversed(list(enumerate(self.filters))):
            if mask >> place & 1:
                continue
            if number == DEFLATE:
                raw = zlib.decompress(raw)
            elif number == SHUFFLE:
                whole = len(raw) // self.kind.size * self.kind.size
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(self.kind.size, -1).T.tobytes() + raw[whole:]
            elif number == FLETCHER:
                raw = raw[:-4]
            else:
                raise Unsupported(f"filter {number}")
        return raw

    def read(self, starts: tuple[int, ...] | None = None, counts: tuple[int, ...] | None = None) -> np.ndarray:
        """A box of numbers, as stored."""
        if self.kind.what != "number":
            raise Unsupported("only numbers are read as arrays")
        starts, counts = (0,) * len(self.shape) if starts is None else tuple(starts), self.shape if counts is None else tuple(counts)
        if not all(counts):
            return np.zeros(counts, self.kind.dtype)
        box = tuple(slice(s, s + n) for s, n in zip(starts, counts, strict=True))
        if self.layout[0] == "compact":
            return np.frombuffer(self.layout[1], self.kind.dtype, int(np.prod(self.shape, dtype=np.int64))).reshape(self.shape)[box].copy()
        out = np.full(counts, np.frombuffer(self.fill, self.kind.dtype)[0], self.kind.dtype)
        if not self.stored:
            return out
        if self.layout[0] == "contiguous":
            return self.file.run(self.layout[1], self.kind.dtype, self.shape, starts, counts)
        chunk = self.layout[3]
        for at, address, size, mask in self.chunks(starts, counts):
            low = [max(s, a) for s, a in zip(starts, at, strict=True)]
            high = [min(s + n, a + c) for s, n, a, c in zip(starts, counts, at, chunk, strict=True)]
            if all(a < b for a, b in zip(low, high, strict=True)):
                values = np.frombuffer(self.unfiltered(self.file.at(address, size), mask), self.kind.dtype).reshape(chunk)
                out[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, starts, strict=True))] = values[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, at, strict=True))]
        return out


class File:
    """An open file; use it in a ``with``."""

    def __init__(self, path: str):
        self.handle = open(path, "rb")
        self.widths, self.objects = (8, 8), {}
        try:
            self.base = self._base()
            self.root = self.object(self._root())
        except BaseException:
            self.handle.close()
            raise

    def __enter__(self) -> File:
        return self

    def __exit__(self, *error) -> None:
        self.handle.close()

    def at(self, address: int | None, size: int) -> bytes:
        if address is None or any(w not in (2, 4, 8) for w in self.widths):
            raise Unsupported("an address is missing")
        self.handle.seek(self.base + address)
        raw = self.handle.read(size)
        if len(raw) != size:
            raise Unsupported("the file ends too early")
        return raw

    def bytes(self, address: int, size: int) -> Bytes:
        return Bytes(self.at(address, size), 0, self.widths)

    def _base(self) -> int:
        """Where the file begins: at 0, or after a block of the user's own of 512 bytes, or twice, four times… that."""
        end, place = self.handle.seek(0, 2), 0
        while place < end:
            self.handle.seek(place)
            if self.handle.read(8) == SIGNATURE:
                return place
            place = max(512, 2 * place)
        raise Unsupported("no HDF5 file")

    def _root(self) -> int:
        b = Bytes(self.at(0, 16), 8)
        version = b.number(1)
        if version > 3:
            raise Unsupported(f"superblock {version}")
        if version < 2:
            b.take(4)
            self.widths = b.numbers(2, 1)
            b = self.bytes(0, 28 + 6 * self.widths[0])
            b.take(24 + 4 * (version == 1) + 5 * self.widths[0])  # four addresses, and the offset of the root's name
            return b.address()
        self.widths = b.numbers(2, 1)
        b = self.bytes(0, 12 + 4 * self.widths[0])
        b.take(12 + 3 * self.widths[0])
        return b.address()

    def object(self, address: int) -> Object:
        if address not in self.objects:
            out = self.objects[address] = Object(self)
            out.messages = [(t, self.resolved(t, flags, m)) for t, flags, m in self._messages(address)]
        return self.objects[address]

    def resolved(self, message: int, flags: int, b: Bytes) -> Bytes:
        """A message that is kept in another object's header is read from there."""
        if not flags & 2 or message != DATATYPE:
            return b
        version, how = b.numbers(2, 1)
        b.take(6 * (version == 1))
        if version == 3 and how != 2:
            raise Unsupported("shared messages in a heap")
        return self.object(b.address()).first(DATATYPE)

    def _messages(self, address: int) -> Iterator[tuple[int, int, Bytes]]:
        if self.at(address, 1) == b"\x01":
            b = Bytes(self.at(address, 16))
            b.take(8)
            blocks, new, order = [(address + 16, b.number(4))], False, 0
        else:
            b = Bytes(self.at(address, 36))
            b.expect(b"OHDR\x02")
            flags = b.number(1)
            b.take(16 * bool(flags & 32) + 4 * bool(flags & 16))
            size = b.number(1 << (flags & 3))
            blocks, new, order = [(address + b.at, size)], True, 2 * bool(flags & 4)
        while blocks:
            at, size = blocks.pop(0)
            b = self.bytes(at, size)
            while b.at + (4 + order if new else 8) <= size:
                message, length, flags = (b.number(1), b.number(2), b.number(1)) if new else (b.number(2), b.number(2), b.number(1))
                b.take(order if new else 3)
                if b.at + length > size:
                    break
                body = Bytes(b.take(length), 0, self.widths)
                if message == CONTINUED:
                    there, n = body.address(), body.length()
                    if new:
                        if self.at(there, 4) != b"OCHK":
                            raise Unsupported("a continued header is missing")
                        there, n = there + 4, n - 8
                    blocks.append((there, n))
                else:
                    yield message, flags, body

    # Groups.

    def local_heap(self, address: int) -> bytes:
        b = self.bytes(address, 8 + 2 * self.widths[1] + self.widths[0])
        b.expect(b"HEAP\0")
        b.take(3)
        size = b.length()
        b.length()
        return self.at(b.address(), size)

    def symbols(self, address: int, names: bytes) -> Iterator[tuple[str, int]]:
        o, n = self.widths
        b = self.bytes(address, 8 + 2 * o)
        if b.raw[:4] == b"SNOD":
            count = int.from_bytes(b.raw[6:8], "little")
            b = self.bytes(address + 8, count * (2 * o + 24))
            for _ in range(count):
                name, there = b.number(o), b.address()
                b.take(24)
                yield names[name:].partition(b"\0")[0].decode(), there
            return
        b.expect(b"TREE\0")
        b.take(1)
        count = b.number(2)
        b = self.bytes(address + 8 + 2 * o, count * (n + o))
        for _ in range(count):
            b.take(n)
            yield from self.symbols(b.address(), names)

    def link(self, b: Bytes) -> tuple[int | None, str, int | None]:
        """Number in the order of creation, name, and address; None for links that aren't hard."""
        b.expect(b"\1")
        flags = b.number(1)
        soft = b.number(1) if flags & 8 else 0
        order = b.number(8) if flags & 4 else None
        b.take(bool(flags & 16))
        name = b.take(b.number(1 << (flags & 3))).decode()
        return order, name, None if soft else b.address()

    def dense(self, heap: int, index: int) -> list[tuple[int, Bytes]]:
        """Objects of a fractal heap that an index lists, with their numbers in the order of creation (0 where unknown)."""
        o, n = self.widths
        b = self.bytes(heap, 26 + 12 * n + 3 * o)
        b.expect(b"FRHP\0")
        _, filtered = b.numbers(2, 2)
        if filtered:
            raise Unsupported("a heap with filters")
        b.take(1)
        largest = b.number(4)
        b.take(n + o + n + o + 8 * n)
        width, start, most, bits = b.number(2), b.length(), b.length(), b.number(2)
        b.take(2)
        root, rows = b.address(), b.number(2)
        place_bytes = (bits + 7) // 8
        size_bytes = min((most.bit_length() + 6) // 8, (largest.bit_length() + 7) // 8)

        def row_size(row: int) -> int:
            return start << max(0, row - 1)

        def find(address: int, first: int, n_rows: int, place: int, size: int) -> bytes:
            if not n_rows:
                return self.at(address + place - first, size)
            entries = self.bytes(address + 5 + o + place_bytes, n_rows * width * o)
            at = first
            for row in range(n_rows):
                for _ in range(width):
                    child, step = entries.address(), row_size(row)
                    if place < at + step:
                        deeper = 0 if step <= most else (step // (start * width)).bit_length()
                        return find(child, at, deeper, place, size)
                    at += step
            raise Unsupported("an object beyond its heap")

        out = []
        for order, key in self.records(index):
            if key[0] & 0x30:
                raise Unsupported("huge or tiny objects of a heap")
            place, size = int.from_bytes(key[1 : 1 + place_bytes], "little"), int.from_bytes(key[1 + place_bytes : 1 + place_bytes + size_bytes], "little")
            out.append((order, Bytes(find(root, 0, rows, place, size), 0, self.widths)))
        return out

    def records(self, address: int) -> list[tuple[int, bytes]]:
        """Heap ids of an index by name, with the number in the order of creation that attributes have."""
        b = self.bytes(address, 22 + self.widths[0] + self.widths[1])
        b.expect(b"BTHD\0")
        form, node, size, depth = b.number(1), b.number(4), b.number(2), b.number(2)
        b.take(2)
        root, count = b.address(), b.number(2)
        if form not in (5, 8) or depth > 1:
            raise Unsupported(f"index {form} of depth {depth}")
        most = (node - 10) // size

        def walk(there: int, n: int, level: int) -> Iterator[bytes]:
            x = self.bytes(there, node)
            x.expect(b"BTIN" if level else b"BTLF")
            x.take(2)
            yield from (x.take(size) for _ in range(n))
            for _ in range(n + 1 if level else 0):
                child, m = x.address(), x.number((most.bit_length() + 7) // 8)
                yield from walk(child, m, level - 1)

        rows = list(walk(root, count, depth)) if root is not None else []
        return [(0, r[4:]) if form == 5 else (int.from_bytes(r[9:13], "little"), r[:8]) for r in rows]

    # Values.

    def attribute(self, b: Bytes) -> tuple[str, object]:
        version, flags = b.numbers(2, 1)
        if version not in (1, 2, 3):
            raise Unsupported(f"attribute {version}")
        sizes = b.numbers(3, 2)
        b.take(version == 3)
        pad = (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
        name, about, space = (b.take(pad(n)) for n in sizes)
        name = name.partition(b"\0")[0].decode()
        of = kind(self.resolved(DATATYPE, 2 * (version > 1 and flags & 1), Bytes(about, 0, self.widths)))
        shape = dataspace(Bytes(space, 0, self.widths))
        if shape is None:
            return name, None
        count = int(np.prod(shape, dtype=np.int64))
        return name, self.value(of, shape, Bytes(b.take(count * of.size), 0, self.widths))

    def value(self, of: Kind, shape: tuple[int, ...], b: Bytes) -> object:
        count = int(np.prod(shape, dtype=np.int64))
        if of.what == "number":
            return np.frombuffer(b.raw, of.dtype, count).reshape(shape)
        if of.what == "text":
            found = [b.take(of.size).partition(b"\0")[0] for _ in range(count)]
            return found if shape else found[0]
        if of.what == "list" and of.of.what == "reference":
            return [list(Bytes(raw, 0, self.widths).numbers(len(raw) // of.of.size, of.of.size)) for raw in (self.listed(b, of.of.size) for _ in range(count))]
        return None

    def listed(self, b: Bytes, size: int) -> bytes:
        """The elements of a list, which are in a heap of the whole file."""
        n, address, number = b.number(4), b.address(), b.number(4)
        if not n:
            return b""
        head = self.bytes(address, 8 + self.widths[1])
        head.expect(b"GCOL\1")
        head.take(3)
        heap = self.bytes(address, head.length())
        heap.at = head.at
        while heap.at + 8 + self.widths[1] <= len(heap.raw):
            k = heap.number(2)
            heap.take(6)
            length = heap.length()
            if k == number:
                return heap.take(n * size)
            if not k:
                break
            heap.take(-(-length // 8) * 8)
        raise Unsupported("a list that isn't in its heap")

    def chunk_tree(self, address: int, rank: int, start: int, end: int, step: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """Chunks in the tree's order, without branches that lie outside ``start`` to ``end - 1`` of the outermost dimension."""
        o = self.widths[0]
        b = self.bytes(address, 8 + 2 * o)
        b.expect(b"TREE\1")
        level, count = b.number(1), b.number(2)
        b = self.bytes(address + 8 + 2 * o, count * (16 + 8 * rank + o) + 16 + 8 * rank)
        entries = []
        for k in range(count + 1):
            size, mask = b.numbers(2, 4)
            at = b.numbers(rank, 8)
            b.take(8)
            entries.append((at, b.address() if k < count else None, size, mask))
        for (at, child, size, mask), (after, *_) in zip(entries, entries[1:], strict=False):
            if at[0] >= end or (after[0] < start if level else at[0] + step <= start):
                continue
            if level:
                yield from self.chunk_tree(child, rank, start, end, step)
            else:
                yield at, child, size, mask

    def run(self, address: int, dtype: np.dtype, shape: tuple[int, ...], starts: tuple[int, ...], counts: tuple[int, ...]) -> np.ndarray:
        """A box of an array that lies in one piece: of the outermost dimension only the run is read."""
        row = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
        first, n = (starts[0], counts[0]) if shape else (0, 1)
        values = np.frombuffer(self.at(address + first * row, n * row), dtype).reshape((n, *shape[1:]) if shape else ())
        return values[(slice(None), *(slice(s, s + c) for s, c in zip(starts[1:], counts[1:], strict=True)))].copy() if shape else values.copy()
