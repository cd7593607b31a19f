"""What a source of arrays provides, and the dataset that answers queries from it."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..functions.attributes import Attribute, attribute_text
from ..functions.wire import SEPARATOR, length_header
from ..operators.grid import attach_maps
from ..operators.slab import covering, pick
from ..plans.query import EVERYTHING, QueryError, Term, parse_query
from ..plans.schema import Answer, Leaf, Part, Schema
from ..streaming.body import array_bytes, run_bytes


class Stale(RuntimeError):
    """The source has changed since the dataset was opened."""


class ArraySource(ABC):
    """Extension point: a schema, attributes and the cells of a box of a variable."""

    @abstractmethod
    def schema(self) -> Schema: ...

    @abstractmethod
    def cells(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> DataFrame:
        """``i_<axis>…, value``: a row for each cell of the box, with indices of the whole array."""

    def strided(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...], steps: tuple[int, ...]) -> DataFrame:
        """``cells``, of ``counts`` indices of each axis that are ``steps`` apart."""
        return pick(self.cells(name, starts, covering(counts, steps)), self.schema().find(name).axes, starts, steps)

    def gridded(self, array: Leaf, maps: list[Leaf]) -> DataFrame | None:
        """A grid's cells with a column for each map's value, if the source has a better way than joining cells."""
        return None

    def attributes(self) -> dict[str | None, list[Attribute]]:
        """Attributes of each variable, and under None of the dataset."""
        return {None: []}

    def listed(self) -> list[str]:
        """Variables of attribute text, in source order, also those whose type isn't served."""
        return [v.name for v in self.schema().variables]

    def stamp(self) -> object:
        """Changes when the source does; compared before data is read."""
        return None

    def raw(self) -> Iterator[bytes]:
        """The source's own bytes, if it is one file."""
        raise FileNotFoundError("this dataset has no file of its own")

    def runs(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> Iterator[DataFrame] | None:
        """The box as it is stored, if it is stored in order: DataFrames of ``place, values``, one after the other.

        ``values`` is a run of the box in row-major order, ``place`` that of its first cell.
        """
        return None

    def close(self) -> None:
        """Give back what the source keeps in Spark; it can still be read."""


class Together(ArraySource):
    """The variables of several sources as one dataset; of variables with one name the first counts."""

    def __init__(self, *sources: ArraySource):
        self.sources = sources
        self.of: dict[str, ArraySource] = {}
        for s in sources:
            for v in s.schema().variables:
                self.of.setdefault(v.name, s)

    def schema(self) -> Schema:
        return Schema("", [s.schema().find(name) for name, s in self.of.items()])

    def cells(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> DataFrame:
        return self.of[name].cells(name, starts, counts)

    def strided(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...], steps: tuple[int, ...]) -> DataFrame:
        return self.of[name].strided(name, starts, counts, steps)

    def runs(self, name: str, starts: tuple[int, ...], counts: tuple[int, ...]) -> Iterator[DataFrame] | None:
        return self.of[name].runs(name, starts, counts)

    def gridded(self, array: Leaf, maps: list[Leaf]) -> DataFrame | None:
        source = self.of[array.name]
        return source.gridded(array, maps) if all(self.of[m.name] is source for m in maps) else None

    def attributes(self) -> dict[str | None, list[Attribute]]:
        return {None: [a for s in self.sources for a in s.attributes().get(None, [])]} | {name: s.attributes().get(name, []) for name, s in self.of.items()}

    def listed(self) -> list[str]:
        return list(dict.fromkeys(name for s in self.sources for name in s.listed()))

    def stamp(self) -> object:
        return tuple(s.stamp() for s in self.sources)

    def close(self) -> None:
        for s in self.sources:
            s.close()


class Dataset:
    """A source under a key: schema and attributes are read once, at opening.

    With ``steps`` queries may have ranges ``[first:step:last]``, which are errors else.
    """

    def __init__(self, key: str, source: ArraySource, steps: bool = False):
        self.key, self.source, self.steps = key, source, steps
        self.schema = Schema(key, source.schema().variables)
        self._attributes = attribute_text(source.listed(), source.attributes())
        self._stamp = source.stamp()

    def terms(self, query: str | None, on_malformed: str = "error") -> tuple[Term, ...]:
        """The query's terms; with ``on_malformed="all"`` text that doesn't parse asks for everything."""
        if query is None:
            return EVERYTHING
        try:
            return parse_query(query)
        except QueryError:
            if on_malformed == "all":
                return EVERYTHING
            raise

    def bind(self, query: str | None = None, on_malformed: str = "error") -> Answer:
        return self.schema.bind(self.terms(query, on_malformed), self.steps)

    def das(self) -> str:
        """Attribute text; no job, no file access."""
        return self._attributes

    def dds(self, query: str | None = None) -> str:
        """Schema text of the answer; no job, no file access."""
        return str(self.bind(query))

    def check(self) -> None:
        """An error if the source has changed."""
        if self.source.stamp() != self._stamp:
            raise Stale(f"{self.key} has changed since it was opened")

    def leaf(self, leaf: Leaf) -> DataFrame:
        """The cells of one box, unless the source has changed."""
        self.check()
        if leaf.steps is not None:
            return self.source.strided(leaf.name, leaf.starts, leaf.counts, leaf.steps)
        return self.source.cells(leaf.name, leaf.starts, leaf.counts)

    def cells(self, query: str | None = None) -> list[tuple[Part, DataFrame]]:
        """The answer's entries, each with the cells of its array (a grid's maps are ``leaves[1:]`` of the part)."""
        return [(part, self.leaf(part.leaves[0])) for part in self.bind(query).parts]

    def grid(self, query: str) -> DataFrame:
        """A single grid's cells with a column for each map's value."""
        (part,) = self.bind(query).parts
        if part.kind != "grid":
            raise ValueError(f"{part.outer} is no grid")
        array, *maps = part.leaves
        self.check()
        if (cells := self.source.gridded(array, maps)) is not None:
            return cells
        return attach_maps(self.leaf(array), [(m.name, self.leaf(m)) for m in maps], [m.cells for m in maps])

    def dods(self, query: str | None = None, on_malformed: str = "error") -> tuple[int, Iterator[bytes]]:
        """Length and pieces of the data response: schema text, separator, then each array in row-major order.

        A source that has changed is an error here, before there is a piece.
        """
        answer = self.bind(query, on_malformed)
        self.check()

        def body() -> Iterator[bytes]:
            yield str(answer).encode() + SEPARATOR
            for leaf in answer.leaves:
                if not leaf.scalar:
                    yield length_header(leaf.cells)
                if leaf.steps is None and (runs := self.source.runs(leaf.name, leaf.starts, leaf.counts)) is not None:
                    self.check()
                    yield from run_bytes(runs, leaf.type)
                    continue
                axes = [f"i_{a}" for a in self.schema.find(leaf.name).axes]
                yield from array_bytes(self.leaf(leaf), axes, leaf.type, leaf.cells)

        return answer.content_length, body()

    def raw(self) -> Iterator[bytes]:
        return self.source.raw()

    def close(self) -> None:
        self.source.close()

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *error) -> None:
        self.close()
