"""Dotted paths as columns, JSON Pointers and JSONPaths.

A dotted path walks structs, and VARIANT values below which it asks for a JSONPath. Empty
segments are dropped; arrays are not entered. A path that leads nowhere is missing: None
here, and null in typed rows, which don't tell missing from null. VARIANT does.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """The top-level column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def parts(path: str) -> list[str]:
    return [p for p in str(path).split(".") if p]


def find(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column at `path` and its type, or None where there is none."""
    names = parts(path)
    if not names or names[0] not in schema.names:
        return None
    col, kind = ref(names[0]), schema[names[0]].dataType
    for i, name in enumerate(names[1:], 1):
        if isinstance(kind, T.VariantType):
            rest = "".join(f"[{json.dumps(n)}]" for n in names[i:])
            return F.try_variant_get(col, f"${rest}", "variant"), kind
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        col, kind = col.getField(name), kind[name].dataType
    return col, kind


def get(schema: T.StructType, path: str) -> Column:
    found = find(schema, path)
    return F.lit(None).cast("string") if found is None else found[0]


def _with(col: Column | None, kind: T.DataType | None, names: list[str], value: Column) -> Column:
    """`col` with `value` at `names`; what stands in the way and isn't a struct is replaced."""
    if not names:
        return value
    if not isinstance(kind, T.StructType):
        return F.struct(_with(None, None, names[1:], value).alias(names[0]))
    inner = kind[names[0]].dataType if names[0] in kind.names else None
    rest = [col.getField(n).alias(n) for n in kind.names]
    new = _with(col.getField(names[0]) if inner is not None else None, inner, names[1:], value).alias(names[0])
    if inner is None:
        return F.struct(*rest, new)
    return F.struct(*[new if n == names[0] else c for n, c in zip(kind.names, rest, strict=True)])


def put(df: DataFrame, path: str, value: Column) -> DataFrame:
    """`df` with `value` at the dotted path, in place if there is a value, else added last."""
    first, *rest = parts(path)
    known = first in df.columns
    new = _with(ref(first) if known else None, df.schema[first].dataType if known else None, rest, value)
    return df.select(*[new.alias(c) if c == first else ref(c) for c in df.columns], *[] if known else [new.alias(first)])


def cut(df: DataFrame, path: str) -> DataFrame:
    """`df` without the value at the dotted path. A struct that loses its last field goes."""
    first, *rest = parts(path)
    if find(df.schema, path) is None:
        return df
    if not rest:
        return df.select(*[ref(c) for c in df.columns if c != first])

    def without(col: Column, kind: T.StructType, names: list[str]) -> Column | None:
        fields = []
        for n in kind.names:
            if n != names[0]:
                fields.append(col.getField(n).alias(n))
            elif names[1:] and (inner := without(col.getField(n), kind[n].dataType, names[1:])) is not None:
                fields.append(inner.alias(n))
        return F.when(col.isNotNull(), F.struct(*fields)) if fields else None

    new = without(ref(first), df.schema[first].dataType, rest)
    return df.select(*[new.alias(c) if c == first else ref(c) for c in df.columns if c != first or new is not None])


def pointer(path: list[str | int]) -> str:
    """RFC 6901: `~` as `~0`, then `/` as `~1`."""
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in path)


def pointer_parts(text: str) -> list[str]:
    if text == "":
        return []
    if not text.startswith("/"):
        raise ValueError(f"Not a JSON Pointer: {text}")
    return [p.replace("~1", "/").replace("~0", "~") for p in text[1:].split("/")]


def member(name: str) -> str:
    """How a path goes on to a member of this name: `.name` or `["any key"]`."""
    return f".{name}" if re.fullmatch(r"[A-Za-z_$][\w$]*", name) else f"[{json.dumps(name, ensure_ascii=False)}]"


def json_path(path: list[str | int]) -> str:
    """`$.name`, `$["any key"]`, `$[0]`."""
    out = "$"
    for p in path:
        out += f"[{p}]" if isinstance(p, int) else member(p)
    return out
