"""The query tree (QRY1-QRY9, QRY14) and the filter tree (FLT1-FLT3)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Query:
    def key(self) -> tuple:
        """Equal for equal queries: the parts of And and Or in any order (QRY14)."""
        raise NotImplementedError

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Query) and self.key() == other.key()

    def __hash__(self) -> int:
        return hash(self.key())


def _boost(b: float) -> float:
    if not b > 0:
        raise ValueError("a boost must be above 0")
    return float(b)


@dataclass(frozen=True, eq=False)
class Term(Query):
    field: str
    term: str
    boost: float = 1.0

    def __post_init__(self) -> None:
        _boost(self.boost)

    def key(self) -> tuple:
        return ("term", self.field, self.term, self.boost)


@dataclass(frozen=True, eq=False)
class Phrase(Query):
    field: str
    terms: tuple[str, ...]
    boost: float = 1.0

    def __post_init__(self) -> None:
        _boost(self.boost)

    def key(self) -> tuple:
        return ("phrase", self.field, self.terms, self.boost)


@dataclass(frozen=True, eq=False)
class Range(Query):
    """Bounds are compared as strings."""

    field: str
    start: str
    end: str
    with_start: bool = True
    with_end: bool = True
    boost: float = 1.0

    def key(self) -> tuple:
        return ("range", self.field, self.start, self.end, self.with_start, self.with_end, self.boost)


@dataclass(frozen=True, eq=False)
class Prefix(Query):
    """Documents with a term that begins so; all score alike."""

    field: str
    start: str
    boost: float = 1.0

    def __post_init__(self) -> None:
        _boost(self.boost)

    def key(self) -> tuple:
        return ("prefix", self.field, self.start, self.boost)


@dataclass(frozen=True, eq=False)
class MatchAll(Query):
    boost: float = 1.0

    def key(self) -> tuple:
        return ("all", self.boost)


@dataclass(frozen=True, eq=False)
class Payload(Query):
    """Documents with this payload; the score is multiplied by the payload's scorer."""

    field: str
    boost: float = 1.0

    def key(self) -> tuple:
        return ("payload", self.field, self.boost)


@dataclass(frozen=True, eq=False)
class _Many(Query):
    parts: tuple[Query, ...] = field(default=())
    boost: float = 1.0

    def __post_init__(self) -> None:
        _boost(self.boost)
        flat: list[Query] = []
        for p in self.parts:  # nested trees of one kind are one list
            flat.extend(p.parts if type(p) is type(self) and p.boost == 1.0 else [p])
        object.__setattr__(self, "parts", tuple(flat))

    def key(self) -> tuple:
        return (type(self).__name__, tuple(sorted((p.key() for p in self.parts), key=repr)), self.boost)


class And(_Many):
    pass


class Or(_Many):
    pass


@dataclass(frozen=True, eq=False)
class Difference(Query):
    left: Query
    right: Query
    boost: float = 1.0

    def key(self) -> tuple:
        return ("difference", self.left.key(), self.right.key(), self.boost)


@dataclass(frozen=True, eq=False)
class Lazy(Query):
    """Text that is parsed when the query is compiled (QRY9)."""

    text: str
    boost: float = 1.0

    def key(self) -> tuple:
        return ("lazy", self.text, self.boost)


def lazy_leaf(q: Query) -> Lazy | None:
    """The first unparsed leaf of a tree."""
    if isinstance(q, Lazy):
        return q
    below = q.parts if isinstance(q, _Many) else (q.left, q.right) if isinstance(q, Difference) else ()
    return next((x for x in map(lazy_leaf, below) if x), None)


@dataclass(frozen=True)
class ValueFilter:
    field: str
    value: str


@dataclass(frozen=True)
class RangeFilter:
    """Both ends are in the range; compared as strings."""

    field: str
    start: str
    end: str


@dataclass(frozen=True)
class BoolFilter:
    any: bool
    parts: frozenset
