"""JSON Schema keywords as column expressions over typed records.

Covered: type, enum, minLength, maxLength, minItems, maxItems, items, required, properties,
minimum, maximum; other keywords are ignored. A wrong type ends the checks of its value.
Typed rows hold a missing field as null, so null is an error where a field is required and
no error elsewhere. A wrong element of an array is reported at the array.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.paths import pointer, ref
from docloom.semantics import identical, is_number

Check = tuple[str, str, str, Column]  # keyword, pointer, message, violated


def _fits(col: Column, kind: T.DataType, name: str) -> Column:
    if name == "null":
        return col.isNull()
    if name in ("number", "integer"):
        if not is_number(kind):
            return F.lit(False)
        whole = F.lit(True) if name == "number" or isinstance(kind, T.IntegralType) else col == F.floor(col)
        return col.isNull() | whole
    other = {"string": (T.StringType, T.DatetimeType, T.TimestampNTZType), "boolean": T.BooleanType, "object": (T.StructType, T.MapType), "array": T.ArrayType}
    return F.lit(name in other and isinstance(kind, other[name]))


def _checks(col: Column, kind: T.DataType, schema: dict[str, Any], path: list[str]) -> list[Check]:
    out: list[Check] = []
    at = pointer(path) or "/"
    ok = col.isNotNull()
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = F.lit(False)
        for n in names:
            fits = fits | _fits(col, kind, n)
        out.append(("type", at, f"Expected {' or '.join(names)}", col.isNotNull() & ~fits))
        ok = ok & fits
    if "enum" in schema:
        one = F.lit(False)
        for v in schema["enum"]:
            one = one | identical((col, kind), v)
        out.append(("enum", at, "Value is not one of the allowed values", ok & ~one))
    if isinstance(kind, T.StringType):
        for name, worse in (("minLength", F.length(col) < schema.get("minLength", 0)), ("maxLength", F.length(col) > schema.get("maxLength", 0))):
            if name in schema:
                out.append((name, at, f"{name} is {schema[name]}", ok & worse))
    if is_number(kind):
        for name, worse in (("minimum", col < schema.get("minimum", 0)), ("maximum", col > schema.get("maximum", 0))):
            if name in schema:
                out.append((name, at, f"{name} is {schema[name]}", ok & worse))
    if isinstance(kind, T.ArrayType):
        for name, worse in (("minItems", F.size(col) < schema.get("minItems", 0)), ("maxItems", F.size(col) > schema.get("maxItems", 0))):
            if name in schema:
                out.append((name, at, f"{name} is {schema[name]}", ok & worse))
        if isinstance(schema.get("items"), dict):
            inner, item = schema["items"], kind.elementType
            # The checks of an item are few; each takes one pass over the array.
            for i, (name, where, message, _) in enumerate(_checks(F.lit(None).cast(item), item, inner, path)):
                bad = F.exists(col, lambda x: F.coalesce(_checks(x, item, inner, path)[i][3], F.lit(False)))  # noqa: B023
                out.append((name, where, f"An item: {message}", ok & bad))
    if isinstance(kind, T.StructType):
        out += _object_checks(lambda n: col.getField(n), kind, schema, path, ok)
    return out


def _object_checks(field, kind: T.StructType, schema: dict[str, Any], path: list[str], ok: Column) -> list[Check]:
    out: list[Check] = []
    for name in schema.get("required", []):
        lacking = field(name).isNull() if name in kind.names else F.lit(True)
        out.append(("required", pointer([*path, name]), "Missing required property", ok & lacking))
    for name, inner in schema.get("properties", {}).items():
        if name in kind.names:
            out += [(k, p, m, ok & bad) for k, p, m, bad in _checks(field(name), kind[name].dataType, inner, [*path, name])]
    return out


def diagnostics(df: DataFrame, schema: dict[str, Any]) -> Column:
    """The array of {keyword, message, pointer} of a record; empty if it is valid."""
    names = schema.get("type", "object")
    if "object" not in (names if isinstance(names, list) else [names]):
        return F.array(F.struct(F.lit("type").alias("keyword"), F.lit(f"Expected {names}").alias("message"), F.lit("/").alias("pointer")))
    found = _object_checks(ref, df.schema, schema, [], F.lit(True))
    rows = [F.when(bad, F.struct(F.lit(k).alias("keyword"), F.lit(m).alias("message"), F.lit(p).alias("pointer"))) for k, p, m, bad in found]
    return F.array_compact(F.array(*rows)) if rows else F.array().cast("array<struct<keyword:string,message:string,pointer:string>>")


def validate(df: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """A row per violation: the record's columns, keyword, message and pointer."""
    return df.withColumn("diagnostic", F.explode(diagnostics(df, schema))).select(*df.columns, "diagnostic.*")


def valid(df: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """The records without a violation."""
    return df.where(F.size(diagnostics(df, schema)) == 0)
