"""Equality, order and literals of JSON values over typed columns."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that counts as a number when values are compared or summed.
DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: Stands for the group of missing, null and empty keys.
UNDEFINED = "__undefined__"


compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def literal(value: Any) -> Column:
    """A JSON value as a column: numbers stay exact, containers become structs and arrays."""
    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, (dict, list)):
        text = F.lit(compact(value))
        return F.from_json(text, F.schema_of_json(text))
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) >= 1 << 63:
        return F.lit(str(value)).cast("decimal(38,0)")
    return F.lit(value)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def identical(found: tuple[Column, T.DataType] | None, value: Any, given: bool = True) -> Column:
    """Whether a value is the given JSON value. Types must agree: 1 isn't "1". Where no
    value was given, what is missing is meant. In VARIANT null isn't missing; typed rows
    hold both as null."""
    if found is None:
        return F.lit(not given)
    col, kind = found
    if not given:
        return col.isNull()
    if isinstance(kind, T.VariantType):
        return F.coalesce(F.to_json(col) == compact(value), F.lit(False))
    if value is None:
        return col.isNull()
    if isinstance(value, (dict, list)):
        return F.coalesce(F.to_json(col) == compact(value), F.lit(False)) if is_nested(kind) else F.lit(False)
    if is_nested(kind):
        return F.lit(False)
    if isinstance(value, bool):
        same = isinstance(kind, T.BooleanType)
    elif isinstance(value, str):
        same = not is_number(kind) and not isinstance(kind, T.BooleanType)
        col = col if isinstance(kind, T.StringType) else col.cast("string")
    else:
        same = is_number(kind)
    return F.coalesce(col == literal(value), F.lit(False)) if same else F.lit(False)


def comparable(col: Column, kind: T.DataType) -> Column:
    """The text by which values are grouped: missing and null are empty."""
    text = F.to_json(col) if is_nested(kind) else col.cast("string")
    return F.coalesce(text, F.lit(""))


def as_number(text: Column) -> Column:
    return F.when(text.rlike(DECIMAL), text.try_cast("decimal(38,18)"))


def sort_keys(col: Column, kind: T.DataType, descending: bool = False) -> list[tuple[Column, bool]]:
    """Columns, with whether they descend, that put null and missing first (last if
    descending); numbers, and texts that are numbers, by value; other texts after them by
    code point."""
    if not is_nested(kind) and not isinstance(kind, T.StringType):
        return [(col, descending)]
    text = comparable(col, kind)
    number = as_number(text)
    return [(c, descending) for c in (F.when(text != "", 1), F.when(number.isNull(), 1), number, F.when(number.isNull(), text))]


def exact(col: Column, kind: T.DataType) -> Column:
    """A number as a decimal of up to 38 digits; null for what isn't a number."""
    if isinstance(kind, T.DecimalType):
        return col.cast(T.DecimalType(38, kind.scale))
    if isinstance(kind, T.IntegralType):
        return col.cast("decimal(38,0)")
    if isinstance(kind, T.FractionalType):
        return col.try_cast("decimal(38,10)")
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(col, "$", "decimal(38,10)")
    return F.lit(None).cast("decimal(38,0)")
