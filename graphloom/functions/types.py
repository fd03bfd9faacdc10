"""The seven scalar types of fields and what a missing value stands for in search criteria."""

from __future__ import annotations

import datetime as dt
import decimal
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataType(Enum):
    INTEGER = "Integer"
    DECIMAL = "Decimal"
    STRING = "String"
    DATETIME = "DateTime"
    BOOLEAN = "Boolean"
    ENUM = "Enum"
    GUID = "Guid"


class Cardinality(Enum):
    MANDATORY = "SingleMandatory"
    OPTIONAL = "SingleOptional"
    MANY = "Multiple"


_SPARK = {
    DataType.INTEGER: T.LongType(),
    DataType.STRING: T.StringType(),
    DataType.DATETIME: T.TimestampNTZType(),
    DataType.BOOLEAN: T.BooleanType(),
    DataType.ENUM: T.IntegerType(),
    DataType.GUID: T.StringType(),
}

#: What a missing value of a type equals in a search criterion.
DEFAULTS: dict[DataType, Any] = {
    DataType.INTEGER: 0,
    DataType.DECIMAL: decimal.Decimal(0),
    DataType.DATETIME: dt.datetime(1, 1, 1),
    DataType.BOOLEAN: False,
    DataType.STRING: "",
}


def spark_type(kind: DataType, precision: int = 38, scale: int = 9) -> T.DataType:
    return T.DecimalType(precision, scale) if kind is DataType.DECIMAL else _SPARK[kind]


def literal(value: Any, kind: T.DataType) -> Column:
    """A literal of a column's type, so that a comparison with the column stays free of casts and reaches the scan."""
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    return F.lit(value).cast(kind)


def _number(value: Any) -> decimal.Decimal:
    return value if isinstance(value, decimal.Decimal) else decimal.Decimal(str(value))


def _grid(kind: T.DataType) -> tuple[int, decimal.Decimal] | None:
    """(digits behind the point, largest magnitude) of a whole or decimal type."""
    if isinstance(kind, T.DecimalType):
        return kind.scale, decimal.Decimal(10**kind.precision - 1).scaleb(-kind.scale)
    bits = {T.LongType: 63, T.IntegerType: 31}.get(type(kind))
    return (0, decimal.Decimal(2**bits - 1)) if bits else None


def bounds(low: Any, high: Any, kind: T.DataType) -> tuple[Any, Any] | None:
    """The least and the greatest value of a number type within [low, high], None if it has none: casts would round out of the range."""
    with decimal.localcontext() as c:
        c.prec = 100
        grid = _grid(kind)
        if grid is None:
            return (low, high) if low <= high else None
        step, most = decimal.Decimal(1).scaleb(-grid[0]), grid[1]
        # beyond what the type holds a bound is the type's own
        first = max(min(_number(low), most + 1), -most - 1).quantize(step, decimal.ROUND_CEILING)
        last = max(min(_number(high), most + 1), -most - 1).quantize(step, decimal.ROUND_FLOOR)
        first, last = max(first, -most), min(last, most)
    if first > last:
        return None
    return (first, last) if isinstance(kind, T.DecimalType) else (int(first), int(last))


def holds(value: decimal.Decimal, kind: T.DataType) -> bool:
    """Whether a number type has exactly this value."""
    return bounds(value, value, kind) is not None


def decode(text: str | None, kind: DataType, variants: tuple[str, ...] = ()) -> Any:
    """A scalar from its text as typed on a command line; ValueError if it isn't one. Empty text is missing."""
    if text is None or text == "":
        return None
    if kind is DataType.INTEGER:
        return int(text)
    if kind is DataType.DECIMAL:
        try:
            return decimal.Decimal(text)
        except decimal.InvalidOperation:
            raise ValueError(f"not a decimal: {text}") from None
    if kind is DataType.DATETIME:
        return dt.datetime.fromisoformat(text).replace(tzinfo=None)
    if kind is DataType.BOOLEAN:
        known = {"true": True, "1": True, "false": False, "0": False}
        if text.lower() not in known:
            raise ValueError(f"not a boolean: {text}")
        return known[text.lower()]
    if kind is DataType.ENUM:
        return variants.index(text) if text in variants else int(text)
    return text.lower() if kind is DataType.GUID else text


def encode(value: Any, kind: DataType, variants: tuple[str, ...] = ()) -> str:
    """The text of a scalar; of a missing one it is empty."""
    if value is None:
        return ""
    if kind is DataType.BOOLEAN:
        return "true" if value else "false"
    if kind is DataType.ENUM:
        return variants[value] if 0 <= value < len(variants) else str(value)
    if kind is DataType.DATETIME:
        return value.isoformat()
    if kind is DataType.DECIMAL:
        return format(value.normalize(), "f")
    return str(value)
