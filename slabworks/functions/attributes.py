"""Attribute text: typed metadata of a dataset and its variables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

# Names by which array files keep their own books; they are never shown.
HIDDEN = ("DIMENSION_LIST", "REFERENCE_LIST", "_NCProperties", "_nc3_strict", "_Netcdf4Dimid", "CLASS", "NAME")

_SHOWN = ("String", "Float32", "Float64", "Int16", "Int32", "Byte")
_BLANK = ("UInt16", "UInt32")  # served without text, but each keeps its line
_SHORT = {"\t": r"\t", "\r": r"\r", "\n": r"\n", "'": r"\'", '"': r"\"", "\\": r"\\"}


@dataclass(frozen=True)
class Attribute:
    """A name, an element type (or ``String``; anything else isn't served) and one or more values."""

    name: str
    type: str
    values: tuple

    @property
    def served(self) -> bool:
        return self.name not in HIDDEN and self.type in (*_SHOWN, *_BLANK)


def quoted(text: str) -> str:
    return '"' + "".join(_SHORT.get(c) or (c if " " <= c <= "~" else f"\\u{{{ord(c):x}}}") for c in text) + '"'


def real(x: float) -> str:
    """Sign, one decimal and a plain exponent: ``-1.0E34``."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return f"{x:+}"
    digits, _, power = f"{x:+.1E}".partition("E")
    return f"{digits}E{int(power)}"


def line(a: Attribute) -> str:
    if a.type in _BLANK:
        return ""
    show = quoted if a.type == "String" else real if a.type.startswith("Float") else str
    return f"{a.type} {a.name} {', '.join(map(show, a.values))};"


def attribute_text(variables: Sequence[str], attributes: dict[str | None, Iterable[Attribute]]) -> str:
    """One block for the dataset (key None, if there is that key) and one for each variable, in order."""
    out = ["Attributes {"]
    blocks = [("NC_GLOBAL", attributes[None])] if None in attributes else []
    for name, own in [*blocks, *((v, attributes.get(v, ())) for v in variables)]:
        out.append(f"    {name} {{")
        out += [f"        {line(a)}" for a in own if a.served]
        out.append("    }")
    return "\n".join([*out, "}"])
