"""Predicates on one column. They are never null for a null column: what a missing value does is folded in when the plan is built."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import bounds, literal


def between(c: Column, kind: T.DataType, low: Any, high: Any, default: Any) -> Column:
    """low <= c <= high; a missing value counts as the default. The form without coalesce can be pushed to the scan."""
    found = bounds(low, high, kind)
    if found is None:  # the type has no value there, nor can its default be
        return F.lit(False)
    inside = (c >= literal(found[0], kind)) & (c <= literal(found[1], kind))
    return inside | c.isNull() if low <= default <= high else inside & c.isNotNull()


def is_boolean(c: Column, value: bool) -> Column:
    return c.isNotNull() & c if value else c.isNull() | ~c


def equals_text(c: Column, value: str) -> Column:
    same = c.isNotNull() & (F.lower(c) == F.lower(F.lit(value)))
    return same | c.isNull() if value == "" else same


def starts_with(c: Column, value: str) -> Column:
    return c.isNotNull() & F.lower(c).startswith(F.lower(F.lit(value)))


def ends_with(c: Column, value: str) -> Column:
    return c.isNotNull() & F.lower(c).endswith(F.lower(F.lit(value)))


def contains(c: Column, value: str) -> Column:
    return c.isNotNull() & F.lower(c).contains(F.lower(F.lit(value)))


def grams(term: str) -> list[str]:
    low = term.lower()
    return [low[i : i + 3] for i in range(len(low) - 2)]


def fuzzy(c: Column, term: str, cutoff: float) -> Column:
    """Whether enough of the term's trigrams (repeats counted) are in the value: a share of `cutoff`, and one at least."""
    parts = grams(term)
    if not parts:
        return F.lit(False)
    need = max(1, math.ceil(cutoff * len(parts) - 1e-6))
    text = F.lower(c)
    hits = sum((F.contains(text, F.lit(g)).cast("int") for g in parts), F.lit(0))
    return c.isNotNull() & (hits >= need)
