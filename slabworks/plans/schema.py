"""Array schemas, how a query binds to one, and the schema text and sizes of the answer.

Binding is all that checks a query, and it needs no job: an index that is out of range
is an error here, never a smaller result later.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from math import prod

from .query import Span, Term


class BindError(ValueError):
    """The query doesn't fit the dataset."""


@dataclass(frozen=True)
class ElementType:
    """An element type: its name in schema text, bytes as stored and on the wire, and Spark's lossless type."""

    name: str
    stored: int
    wire: int
    spark: str
    numpy: str


# Element types of the protocol; 8-bit values aren't padded on the wire, 16-bit ones are.
TYPES = {
    t.name: t
    for t in (
        ElementType("Byte", 1, 1, "smallint", "u1"),
        ElementType("UInt16", 2, 4, "int", "u2"),
        ElementType("UInt32", 4, 4, "bigint", "u4"),
        ElementType("UInt64", 8, 8, "decimal(20,0)", "u8"),
        ElementType("Int16", 2, 4, "smallint", "i2"),
        ElementType("Int32", 4, 4, "int", "i4"),
        ElementType("Int64", 8, 8, "bigint", "i8"),
        ElementType("Float32", 4, 4, "float", "f4"),
        ElementType("Float64", 8, 8, "double", "f8"),
    )
}
_OF_NUMPY = {t.numpy: t for t in TYPES.values()}
_OF_SPARK = {"smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "decimal(20,0)": "UInt64", "tinyint": "Int16"}


def type_of_numpy(kind: str) -> ElementType | None:
    """``kind`` as in numpy's ``dtype.str`` without the byte order; None for types that aren't served."""
    return _OF_NUMPY.get(kind)


def type_of_spark(kind: str) -> ElementType | None:
    return TYPES.get(_OF_SPARK.get(kind, ""))


@dataclass(frozen=True)
class Variable:
    """A dense array in row-major order; ``type`` is None where the type isn't served.

    An array without named dimensions has its own name as the one label, whatever its
    rank, so ``dims`` can be shorter than ``shape``.
    """

    name: str
    type: ElementType | None
    dims: tuple[str, ...]
    shape: tuple[int, ...]

    @property
    def axes(self) -> tuple[str, ...]:
        """A name for each axis, which cells use."""
        return tuple(self.dims[k] if k < len(self.dims) else f"{self.name}_{k}" for k in range(len(self.shape)))


@dataclass(frozen=True)
class Leaf:
    """A box of one variable: ``starts`` and ``counts`` of each axis, and the dimensions as shown.

    With ``steps`` it takes every so many indices of each axis; None if that is every one.
    """

    name: str
    type: ElementType
    shown: tuple[tuple[str, int], ...]
    starts: tuple[int, ...]
    counts: tuple[int, ...]
    steps: tuple[int, ...] | None = None

    @property
    def cells(self) -> int:
        return prod(self.counts)

    @property
    def scalar(self) -> bool:
        return not self.shown

    @property
    def stored_bytes(self) -> int:
        return self.cells * self.type.stored

    @property
    def wire_bytes(self) -> int:
        return self.cells * self.type.wire + (0 if self.scalar else 8)

    def __str__(self) -> str:
        return f"{self.type.name} {self.name}" + "".join(f"[{d} = {n}]" for d, n in self.shown) + ";"


@dataclass(frozen=True)
class Part:
    """One entry of an answer: a ``variable``, a ``grid`` (array, then its maps) or a ``structure`` around a member."""

    kind: str
    outer: str
    leaves: tuple[Leaf, ...]

    def lines(self) -> Iterator[str]:
        first, *maps = self.leaves
        if self.kind == "variable":
            yield f"    {first}"
        elif self.kind == "structure":
            yield from ("    Structure {", f"        {first}", f"    }} {self.outer};")
        else:
            yield from ("    Grid {", "     ARRAY:", f"        {first}", "     MAPS:")
            yield from (f"        {m}" for m in maps)
            yield f"    }} {self.outer};"


@dataclass(frozen=True)
class Answer:
    """What a query asks of a dataset, bound and checked."""

    dataset: str
    parts: tuple[Part, ...]

    @property
    def leaves(self) -> Iterator[Leaf]:
        return (leaf for part in self.parts for leaf in part.leaves)

    @property
    def stored_bytes(self) -> int:
        return sum(leaf.stored_bytes for leaf in self.leaves)

    @property
    def wire_bytes(self) -> int:
        return sum(leaf.wire_bytes for leaf in self.leaves)

    @property
    def content_length(self) -> int:
        """Bytes of the whole data response: schema text, separator, arrays."""
        return len(str(self).encode()) + 8 + self.wire_bytes

    def __str__(self) -> str:
        return "\n".join(["Dataset {", *(line for part in self.parts for line in part.lines()), f"}} {self.dataset};"])


@dataclass(frozen=True)
class Schema:
    """A dataset's variables in the order of its source; those of types that aren't served are left out."""

    dataset: str
    variables: tuple[Variable, ...]
    by_name: dict[str, Variable] = field(init=False, repr=False, compare=False)

    def __init__(self, dataset: str, variables: Iterable[Variable]):
        object.__setattr__(self, "dataset", dataset)
        object.__setattr__(self, "variables", tuple(v for v in variables if v.type is not None))
        object.__setattr__(self, "by_name", {v.name: v for v in self.variables})

    def find(self, name: str) -> Variable:
        if name not in self.by_name:
            raise BindError(f"no variable {name}")
        return self.by_name[name]

    def position(self, name: str) -> int:
        return next(k for k, v in enumerate(self.variables) if v.name == name)

    def gridded(self, v: Variable) -> bool:
        """More than one dimension, and each is a variable too."""
        return len(v.dims) > 1 and all(d in self.by_name for d in v.dims)

    def bind(self, terms: Sequence[Term], steps: bool = False) -> Answer:
        """Without terms all variables by name; else what is asked for, in the order of the source.

        Terms of one outer variable keep the order asked for, and repeats stay. Steps in
        ranges are an error unless ``steps`` allows them.
        """
        if not terms:
            return Answer(self.dataset, tuple(self._whole(self.by_name[n]) for n in sorted(self.by_name, key=str.encode)))
        parts = [self._part(t, steps) for t in terms]
        return Answer(self.dataset, tuple(sorted(parts, key=lambda p: self.position(p.outer))))

    def _whole(self, v: Variable) -> Part:
        def leaf(x: Variable) -> Leaf:
            return Leaf(x.name, x.type, tuple(zip(x.dims, x.shape, strict=False)), (0,) * len(x.shape), x.shape)

        if self.gridded(v):
            return Part("grid", v.name, (leaf(v), *(leaf(self.by_name[d]) for d in v.dims)))
        return Part("variable", v.name, (leaf(v),))

    def _part(self, term: Term, stepped: bool) -> Part:
        outer = self.find(term.variable)
        v = outer if term.member is None else self.find(term.member)
        starts, counts = box(v, term.spans, stepped)
        steps = steps_of(v, term.spans)
        array = Leaf(v.name, v.type, tuple(zip(v.dims, counts, strict=False)), starts, counts, steps)
        if term.member is not None:
            return Part("structure", outer.name, (array,))
        if not self.gridded(v):
            return Part("variable", v.name, (array,))
        each = steps or (1,) * len(counts)
        maps = (Leaf(d, self.by_name[d].type, ((d, n),), (at,), (n,), (s,) if s > 1 else None) for d, at, n, s in zip(v.dims, starts, counts, each, strict=False))
        return Part("grid", v.name, (array, *maps))


def steps_of(v: Variable, spans: tuple[Span, ...] | None) -> tuple[int, ...] | None:
    """Steps of each axis; None if all are 1. A range of one index has none."""
    steps = tuple((s.step or 1) if s.count > 1 else 1 for s in spans or ())
    return steps + (1,) * (len(v.shape) - len(steps)) if any(s > 1 for s in steps) else None


def box(v: Variable, spans: tuple[Span, ...] | None, stepped: bool = False) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Starts and counts of each axis; axes without a bracket are whole, and nothing is clamped.

    The ends of a range have to be in the dimension, also one that its steps don't reach.
    """
    if spans is None:
        return (0,) * len(v.shape), v.shape
    if any(s.step is not None for s in spans) and not stepped:
        raise BindError(f"{v.name}: steps aren't supported")
    if any(s.step == 0 for s in spans):
        raise BindError(f"{v.name}: a step of 0")
    if len(spans) > len(v.shape):
        raise BindError(f"{v.name}: more brackets than dimensions")
    if any(s.last < s.first for s in spans):
        raise BindError(f"{v.name}: a range runs backwards")
    starts = tuple(s.first for s in spans) + (0,) * (len(v.shape) - len(spans))
    if any(at >= n for at, n in zip(starts, v.shape, strict=True)):
        raise BindError(f"{v.name}: an index is out of range")
    counts = tuple(s.count for s in spans) + v.shape[len(spans) :]
    if any(s.last >= n for s, n in zip(spans, v.shape, strict=False)):
        raise BindError(f"{v.name}: a range ends past its dimension")
    return starts, counts
