"""Small HDF5 files by the published format: the root group's arrays with their dimension scales.

Superblock 0, a symbol table, headers of version 1, chunked (shuffled, deflated) or
contiguous arrays. Arrays are whole in memory, so this is for coordinates, samples and
tests; large results go to chunk stores.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from .hdf5_format import ATTRIBUTE, DATASPACE, DATATYPE, DEFLATE, FILL, FILTERS, LAYOUT, SHUFFLE, SIGNATURE, SYMBOLS

NOWHERE = b"\xff" * 8
LEAF, INTERNAL, CHUNK_ENTRIES = 4, 16, 64
# Fixed values of the format: exponent and mantissa of floating-point numbers by size: places, sizes and bias.
FLOATS = {4: (23, 8, 0, 23, 127), 8: (52, 11, 0, 52, 1023)}


@dataclass
class Array:
    """What is written under a name; ``chunk`` None is contiguous storage, ``dims`` are names of other arrays."""

    values: np.ndarray
    dims: tuple[str, ...] = ()
    attributes: dict[str, object] = field(default_factory=dict)
    chunk: tuple[int, ...] | None = None
    deflate: bool = True
    shuffle: bool = True
    fill: object = None


def padded(raw: bytes, n: int = 8) -> bytes:
    return raw + b"\0" * (-len(raw) % n)


def datatype(dtype: np.dtype) -> bytes:
    big = dtype.byteorder == ">"
    if dtype.kind == "S":
        return struct.pack("<B3sI", 0x13, bytes(3), dtype.itemsize)
    if dtype.kind == "f":
        exponent, exponent_size, mantissa, mantissa_size, bias = FLOATS[dtype.itemsize]
        bits = bytes([0x20 | big, 8 * dtype.itemsize - 1, 0])
        return struct.pack("<B3sIHHBBBBI", 0x11, bits, dtype.itemsize, 0, 8 * dtype.itemsize, exponent, exponent_size, mantissa, mantissa_size, bias)
    return struct.pack("<B3sIHH", 0x10, bytes([8 * (dtype.kind == "i") | big, 0, 0]), dtype.itemsize, 0, 8 * dtype.itemsize)


REFERENCES = struct.pack("<B3sI", 0x19, bytes(3), 16) + struct.pack("<B3sI", 0x17, bytes(3), 8)


def dataspace(shape: tuple[int, ...]) -> bytes:
    return struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)


def attribute(name: str, kind: bytes, shape: tuple[int, ...], raw: bytes) -> bytes:
    key, space = name.encode() + b"\0", dataspace(shape)
    return struct.pack("<BxHHH", 1, len(key), len(kind), len(space)) + padded(key) + padded(kind) + padded(space) + raw


def plain_attribute(name: str, value: object) -> bytes:
    a = np.asarray(value.encode() if isinstance(value, str) else value)
    return attribute(name, datatype(a.dtype), a.shape, a.tobytes())


class Out:
    """The bytes of a file; what is added gets an address, a multiple of 8."""

    def __init__(self):
        self.raw = bytearray(96)

    def add(self, piece: bytes) -> int:
        at = len(self.raw)
        self.raw += padded(piece)
        return at

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", t, len(padded(m)), 0) + padded(m) for t, m in messages)
        return self.add(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def chunks(self, a: Array) -> int:
        """The address of the tree of an array's chunks; its branches are made level by level."""
        values, chunk, entries = a.values, a.chunk, []
        for at in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, chunk, strict=True))):
            offsets = tuple(i * c for i, c in zip(at, chunk, strict=True))
            part = values[tuple(slice(o, o + c) for o, c in zip(offsets, chunk, strict=True))]
            whole = np.zeros(chunk, values.dtype)
            whole[tuple(slice(0, n) for n in part.shape)] = part
            raw = whole.tobytes()
            if a.shuffle:
                raw = np.frombuffer(raw, np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
            if a.deflate:
                raw = zlib.compress(raw)
            entries.append((offsets, self.add(raw), len(raw)))
        last = struct.pack(f"<II{values.ndim}QQ", 0, 0, *values.shape, 0)
        level, nodes = 0, [(struct.pack(f"<II{values.ndim}QQ", size, 0, *offsets, 0), at) for offsets, at, size in entries]
        while True:
            made = []
            for k in range(0, len(nodes), CHUNK_ENTRIES):
                own, after = nodes[k : k + CHUNK_ENTRIES], nodes[k + CHUNK_ENTRIES : k + CHUNK_ENTRIES + 1]
                body = b"".join(key + struct.pack("<Q", at) for key, at in own) + (after[0][0] if after else last)
                room = 24 + CHUNK_ENTRIES * (len(last) + 8) + len(last)
                made.append((own[0][0], self.add((struct.pack("<4sBBH", b"TREE", 1, level, len(own)) + 2 * NOWHERE + body).ljust(room, b"\0"))))
            nodes, level = made, level + 1
            if len(nodes) <= 1:
                return nodes[0][1] if nodes else int.from_bytes(NOWHERE, "little")

    def dataset(self, a: Array, scales: list[int]) -> int:
        values, size = a.values, a.values.dtype.itemsize
        fill = b"" if a.fill is None else np.asarray(a.fill, values.dtype).tobytes()
        messages = [(DATASPACE, dataspace(values.shape)), (DATATYPE, datatype(values.dtype)), (FILL, struct.pack("<BBBBI", 2, 2, 2, 1, len(fill)) + fill)]
        if a.chunk:
            names = [(DEFLATE, 1, (6,)) for _ in range(a.deflate)]
            names = [(SHUFFLE, 1, (size,)) for _ in range(a.shuffle)] + names
            if names:
                messages.append((FILTERS, struct.pack("<BB6x", 1, len(names)) + b"".join(struct.pack("<HHHHI4x", f, 0, flag, 1, *v) for f, flag, v in names)))
            messages.append((LAYOUT, struct.pack("<BBBQ", 3, 2, values.ndim + 1, self.chunks(a)) + struct.pack(f"<{values.ndim + 1}I", *a.chunk, size)))
        else:
            messages.append((LAYOUT, struct.pack("<BBQQ", 3, 1, self.add(values.tobytes()) if values.size else int.from_bytes(NOWHERE, "little"), values.nbytes)))
        if scales:
            objects = b"".join(struct.pack("<HH4xQQ", k + 1, 1, 8, at) for k, at in enumerate(scales))
            size = max(4096, 16 + len(objects) + 16)
            heap = self.add((struct.pack("<4sB3xQ", b"GCOL", 1, size) + objects + struct.pack("<HH4xQ", 0, 0, size - 16 - len(objects))).ljust(size, b"\0"))
            messages.append((ATTRIBUTE, attribute("DIMENSION_LIST", REFERENCES, (len(scales),), b"".join(struct.pack("<IQI", 1, heap, k + 1) for k in range(len(scales))))))
        messages += [(ATTRIBUTE, plain_attribute(k, v)) for k, v in a.attributes.items()]
        return self.header(messages)


def write_hdf5(path: str, arrays: dict[str, Array], attributes: dict[str, object] | None = None) -> None:
    """Write arrays as datasets of the root group; an array's ``dims`` must be there too, and none of them has dims of its own."""
    out, made = Out(), {}
    for name in sorted(arrays, key=lambda n: bool(arrays[n].dims)):
        a = arrays[name]
        made[name] = out.dataset(a, [made[d] for d in a.dims])
    names, offsets = bytearray(8), {}
    for name in sorted(made, key=str.encode):
        offsets[name] = len(names)
        names += padded(name.encode() + b"\0")
    keys, children, listed = [0], [], list(offsets)
    for k in range(0, len(listed), 2 * LEAF):
        own = listed[k : k + 2 * LEAF]
        body = b"".join(struct.pack("<QQII16x", offsets[n], made[n], 0, 0) for n in own)
        children.append(out.add(struct.pack("<4sBxH", b"SNOD", 1, len(own)) + body.ljust(2 * LEAF * 40, b"\0")))
        keys.append(offsets[own[-1]])
    if len(children) > 2 * INTERNAL:
        raise ValueError("too many arrays for one file")
    body = b"".join(struct.pack("<QQ", key, child) for key, child in zip(keys, children, strict=False)) + struct.pack("<Q", keys[-1])
    tree = out.add((struct.pack("<4sBBH", b"TREE", 0, 0, len(children)) + 2 * NOWHERE + body).ljust(24 + 2 * INTERNAL * 16 + 8, b"\0"))
    segment = out.add(bytes(names))
    heap = out.add(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names), 1, segment))  # 1: no free block
    root = out.header([(SYMBOLS, struct.pack("<QQ", tree, heap)), *[(ATTRIBUTE, plain_attribute(k, v)) for k, v in (attributes or {}).items()]])
    head = SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", LEAF, INTERNAL, 0)
    head += struct.pack("<Q", 0) + NOWHERE + struct.pack("<Q", len(out.raw)) + NOWHERE
    head += struct.pack("<QQII", 0, root, 1, 0) + struct.pack("<QQ", tree, heap)
    out.raw[: len(head)] = head
    with open(path, "wb") as f:
        f.write(out.raw)
