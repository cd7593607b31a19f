"""The constraint language: ``name[slab],outer.member[slab],…``.

A slab has a bracket for each dimension, from the outermost on: ``[i]``, ``[first:last]``
(both included) or ``[first:step:last]``. No text at all means every variable.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

_NUMBER = re.compile(r"\+?[0-9]+\Z")
# Rule: a bracket closes with one or more ``]``; the further ones say nothing.
_BRACKET = re.compile(r"\[([^\[\]]*)\]+")
_SLAB = re.compile(f"(?:{_BRACKET.pattern})+")


class QueryError(ValueError):
    """The text isn't a constraint."""


@dataclass(frozen=True)
class Span:
    """Indices of one dimension: ``first`` to ``last``, both included."""

    first: int
    last: int
    step: int | None = None

    @property
    def count(self) -> int:
        return self.last - self.first + 1 if self.step is None else (self.last - self.first) // self.step + 1


@dataclass(frozen=True)
class Term:
    """One entry: a variable, or a member shown inside an outer variable's structure."""

    variable: str
    member: str | None = None
    spans: tuple[Span, ...] | None = None


def parse_span(text: str) -> Span:
    numbers = text.split(":")
    if not all(map(_NUMBER.match, numbers)):
        raise QueryError(f"not an index: [{text}]")
    if len(numbers) > 3:
        raise QueryError(f"too many numbers: [{text}]")
    n = [int(x) for x in numbers]
    return Span(n[0], n[-1], n[1] if len(n) == 3 else None)


def parse_slab(text: str) -> tuple[Span, ...]:
    """The spans of ``[…][…]``."""
    if not _SLAB.fullmatch(text):
        raise QueryError(f"not a list of brackets: {text}")
    return tuple(map(parse_span, _BRACKET.findall(text)))


def parse_term(text: str) -> Term:
    outer, dot, rest = text.partition(".")
    name, bracket, slab = (rest if dot else text).partition("[")
    spans = parse_slab(bracket + slab) if bracket else None
    return Term(outer, name, spans) if dot else Term(name, None, spans)


def parse_query(text: str) -> tuple[Term, ...]:
    """Terms in the order asked for.

    Percent escapes are undone first and must give UTF-8; a plus sign stays one. The
    empty text asks for a variable without a name; for all variables give no terms.
    """
    try:
        text = unquote_to_bytes(text).decode()
    except UnicodeDecodeError as e:
        raise QueryError(f"not UTF-8: {text}") from e
    return tuple(parse_term(t) for t in text.split(","))


EVERYTHING: tuple[Term, ...] = ()
