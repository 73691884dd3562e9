"""The jq forms that recipes use, compiled to columns: `.`, `.a.b`, `.[]`, `map(...)`,
`select(path == literal)` and pipes. Records are the items of the outer array.

A path over records gives one `value` per record, without missing ones; objects spread
into fields again. `map` and `.[]` below the records act on arrays within them.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import ExpressionError
from docloom.operators.rows import Rows
from docloom.paths import find, parts, ref
from docloom.semantics import identical

PATH = re.compile(r"\.[A-Za-z_][\w]*(\.[A-Za-z_]\w*)*")


def split_pipes(text: str) -> list[str]:
    """At `|` outside brackets and strings."""
    out, depth, quoted, start, i = [], 0, False, 0, 0
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(text[start:i])
            start = i + 1
        i += 1
    if depth or quoted:
        raise ExpressionError(f"Unbalanced jq expression: {text}")
    return [x.strip() for x in [*out, text[start:]]]


def _condition(text: str, schema: T.StructType) -> Column:
    m = re.fullmatch(r"(\.[\w.]*)\s*(==|!=)\s*(.+)", text.strip(), re.DOTALL)
    if not m:
        raise ExpressionError(f"Unsupported jq condition: {text}")
    try:
        value = json.loads(m[3])
    except ValueError as e:
        raise ExpressionError(f"Not a JSON literal: {m[3]}") from e
    same = identical(_need(schema, m[1]), value)
    return same if m[2] == "==" else ~same


def _need(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    found = find(schema, path)
    if found is None:
        raise ExpressionError(f"jq path not found: {path}")
    return found


def _value(col: Column, kind: T.DataType, text: str) -> tuple[Column, T.DataType]:
    """A stage on a single value of known type."""
    if text == ".":
        return col, kind
    if m := re.fullmatch(r"map\((.*)\)", text, re.DOTALL):
        if not isinstance(kind, T.ArrayType):
            raise ExpressionError("map needs an array")
        inner = m[1].strip()
        if s := re.fullmatch(r"select\((.*)\)", inner, re.DOTALL):
            return F.filter(col, lambda x: _inside(x, kind.elementType, s[1])), kind
        made = []
        out = F.transform(col, lambda x: made.append(_chain(x, kind.elementType, inner)) or made[-1][0])
        return out, T.ArrayType(made[0][1])
    if PATH.fullmatch(text):
        for name in parts(text):
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and name in kind.elementType.names:
                col, kind = F.transform(col, lambda x, n=name: x.getField(n)), T.ArrayType(kind.elementType[name].dataType)
            elif isinstance(kind, T.StructType) and name in kind.names:
                col, kind = col.getField(name), kind[name].dataType
            else:
                raise ExpressionError(f"jq path not found: {text}")
        return col, kind
    raise ExpressionError(f"Unsupported jq expression: {text}")


def _inside(item: Column, kind: T.DataType, text: str) -> Column:
    m = re.fullmatch(r"(\.[\w.]*)\s*(==|!=)\s*(.+)", text.strip(), re.DOTALL)
    if not m:
        raise ExpressionError(f"Unsupported jq condition: {text}")
    same = identical(_value(item, kind, m[1]), json.loads(m[3]))
    return same if m[2] == "==" else ~same


def _chain(col: Column, kind: T.DataType, text: str) -> tuple[Column, T.DataType]:
    for part in split_pipes(text):
        col, kind = _value(col, kind, part)
    return col, kind


def _spread(rows: Rows, col: Column, kind: T.DataType) -> Rows:
    """One value per record, missing ones dropped; objects become records."""
    out = rows.with_df(rows.df.where(col.isNotNull()))
    if isinstance(kind, T.StructType):
        return out.project([col.getField(n).alias(n) for n in kind.names])
    return out.project([col.alias("value")])


def _stage(rows: Rows, text: str) -> Rows:
    schema = rows.schema()
    if text in (".", ".[]"):
        only = schema.fields[0] if len(schema) == 1 and schema.names == ["value"] else None
        if text == ".[]" and only is not None and isinstance(only.dataType, T.ArrayType):
            exploded = rows.df.select(F.explode("value").alias("value"), *rows.hidden)
            return _spread(rows.with_df(exploded), F.col("value"), only.dataType.elementType)
        return rows
    if text.startswith(".[]"):
        return _stage(_stage(rows, ".[]"), text[3:] if text[3:].startswith(".") else "." + text[3:])
    if m := re.fullmatch(r"select\((.*)\)", text, re.DOTALL):
        return rows.with_df(rows.df.where(_condition(m[1], schema)))
    if schema.names == ["value"]:
        return _spread(rows, *_value(ref("value"), schema["value"].dataType, text))
    if m := re.fullmatch(r"map\((.*)\)", text, re.DOTALL):
        for part in split_pipes(m[1]):
            rows = _stage(rows, part)
        return rows
    if PATH.fullmatch(text):
        head, *rest = parts(text)
        col, kind = _need(schema, head)
        return _spread(rows, *(_value(col, kind, "." + ".".join(rest)) if rest else (col, kind)))
    raise ExpressionError(f"Unsupported jq expression: {text}")


def compile_jq(text: str):
    stages = split_pipes(text.strip() or ".")

    def run(rows: Rows) -> Rows:
        for stage in stages:
            rows = _stage(rows, stage)
        return rows

    return run
