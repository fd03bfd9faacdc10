"""Search criteria: a tree that is compiled to column predicates and semi-joins. Bounds are inclusive."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any, Union


class TextMatch(Enum):
    EXACT = "exact"
    PREFIX = "prefix"
    POSTFIX = "postfix"
    SUBSTRING = "substring"
    FUZZY = "fuzzy"


class Combine(Enum):
    AND = "and"
    OR = "or"
    XOR = "xor"


class AssocMatch(Enum):
    SUBQUERY = "subquery"
    NULL = "null"
    NOT_NULL = "not null"


@dataclass(frozen=True)
class Range:
    """An integer, decimal or date and time field between two values; an unset bound is the type's default."""

    field: str
    low: Any = None
    high: Any = None


@dataclass(frozen=True)
class Boolean:
    field: str
    value: bool = False


@dataclass(frozen=True)
class Text:
    field: str
    value: str = ""
    match: TextMatch = TextMatch.SUBSTRING
    cutoff: float = 0.5


@dataclass(frozen=True)
class Equals:
    """Equality of an enum (a variant's name or ordinal) or of an id field."""

    field: str
    value: Any


@dataclass(frozen=True)
class ObjectId:
    value: Any


@dataclass(frozen=True)
class Assoc:
    """Objects with a neighbour over `ref` that meets the criterion (any, if none), with no neighbour, or with one."""

    ref: str
    criterion: "Criterion | None" = None
    match: AssocMatch = AssocMatch.SUBQUERY


@dataclass(frozen=True)
class Multi:
    """All, any, or exactly one of the criteria. Without criteria nothing matches."""

    criteria: tuple["Criterion", ...]
    combine: Combine = Combine.AND


@dataclass(frozen=True)
class Typed:
    """Objects of a type or of one that derives from it."""

    entity: str
    criterion: "Criterion | None" = None


Criterion = Union[Range, Boolean, Text, Equals, ObjectId, Assoc, Multi, Typed]


def all_of(*criteria: Criterion) -> Multi:
    return Multi(criteria, Combine.AND)


def any_of(*criteria: Criterion) -> Multi:
    return Multi(criteria, Combine.OR)


def one_of(*criteria: Criterion) -> Multi:
    return Multi(criteria, Combine.XOR)
