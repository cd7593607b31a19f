"""The data response: big-endian arrays behind their schema text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..plans.schema import ElementType

SEPARATOR = b"\n\nData:\n"


def length_header(n: int) -> bytes:
    """The number of elements, in 32 bits, twice."""
    return (n & 0xFFFFFFFF).to_bytes(4, "big") * 2


def wire_dtype(kind: ElementType) -> np.dtype:
    """Elements of two bytes take four on the wire, single bytes stay as they are."""
    return np.dtype(f">{kind.numpy[0]}{kind.wire}")


def widen(stored: bytes, kind: ElementType, order: str = "big") -> bytes:
    """Wire form of elements of one or two bytes; wider ones have no such form and are refused."""
    if kind.stored > 2:
        raise ValueError(f"{kind.name} isn't widened")
    values = np.frombuffer(stored, np.dtype(f"{'>' if order == 'big' else '<'}{kind.numpy}"))
    return values.astype(wire_dtype(kind)).tobytes()


def encode(values: pa.Array, kind: ElementType) -> bytes:
    if kind.name == "UInt64":
        return np.array([int(v) for v in values.to_pylist()], np.uint64).astype(">u8").tobytes()
    return values.to_numpy(zero_copy_only=False).astype(wire_dtype(kind)).tobytes()
