"""The JSONata forms that recipes use, handed to Spark SQL: `$`, `$[predicate]`,
`.{ 'name': expression, ... }`, paths, `$sort($, function...)` and the aggregates
`$count`, `$sum`, `$average`, `$min`, `$max` over all records.

Within expressions names are fields, texts are quoted, `=`, `!=`, `<`, `and`, `or`, `in`,
`&` and arithmetic work as in SQL, and the functions below are known. Anything else is
refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F

from docloom.errors import ExpressionError
from docloom.operators.rows import HIDDEN, Rows
from docloom.semantics import sort_keys

#: Functions of values, with their Spark names.
FUNCTIONS = {"count": "size", "length": "length", "uppercase": "upper", "lowercase": "lower", "trim": "trim", "abs": "abs", "floor": "floor", "ceil": "ceil", "round": "round", "sqrt": "sqrt", "power": "power", "string": "string", "exists": "isnotnull", "contains": "contains", "join": "array_join", "split": "split", "distinct": "array_distinct", "reverse": "reverse", "not": "not"}
#: Aggregates over all records.
AGGREGATES = {"count": "count", "sum": "sum", "average": "avg", "min": "min", "max": "max"}
OPERATORS = {"=": "=", "!=": "!=", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "+": "+", "-": "-", "*": "*", "/": "/", "%": "%", "&": "||", "(": "(", ")": ")", ",": ","}
TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|\$(?P<call>\w+)(?=\s*\()|(?P<path>(?:\$\.)?(?:[A-Za-z_]\w*|`[^`]+`)(?:\.(?:[A-Za-z_]\w*|`[^`]+`))*)|(?P<op>!=|<=|>=|[=<>+\-*/%&(),]))""")


def to_sql(text: str) -> str:
    """A JSONata expression over one record as Spark SQL."""
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ExpressionError(f"Unsupported JSONata at {at}: {text}")
        at = m.end()
        if m["text"]:
            raw = re.sub(r"\\(.)", r"\1", m["text"][1:-1])
            out.append("'" + raw.replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif m["number"]:
            out.append(m["number"])
        elif m["call"]:
            if m["call"] not in FUNCTIONS:
                raise ExpressionError(f"Unknown JSONata function ${m['call']}: {text}")
            out.append(FUNCTIONS[m["call"]])
        elif m["path"]:
            path = m["path"].removeprefix("$.")
            if path in ("and", "or", "in", "true", "false", "null"):
                out.append(path)
            else:
                out.append(".".join(f"`{p.strip('`')}`" for p in re.findall(r"`[^`]+`|[^.]+", path)))
        else:
            out.append(OPERATORS[m["op"]])
        text = text.rstrip()
    if not out:
        raise ExpressionError("Empty JSONata expression")
    return " ".join(out)


def _closing(text: str, start: int) -> int:
    """The place of the bracket that closes the one at `start`."""
    depth, quote, i = 0, "", start
    while i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i
        i += 1
    raise ExpressionError(f"Unbalanced JSONata: {text}")


def _members(text: str) -> list[tuple[str, str]]:
    out, start = [], 0
    cuts = []
    i = 0
    while i < len(text):
        if text[i] in "([{":
            i = _closing(text, i)
        elif text[i] in "'\"":
            i += 1 + re.compile(rf"(?:[^{text[i]}\\]|\\.)*").match(text, i + 1).end() - i - 1
        elif text[i] == ",":
            cuts.append(i)
        i += 1
    for cut in [*cuts, len(text)]:
        m = re.fullmatch(r"""\s*(?:'([^']*)'|"([^"]*)"|(\w+))\s*:\s*(.+?)\s*""", text[start:cut], re.DOTALL)
        if not m:
            raise ExpressionError(f"Not a JSONata member: {text[start:cut]}")
        out.append((m[1] or m[2] or m[3], m[4]))
        start = cut + 1
    return out


def _project(members: list[tuple[str, str]]) -> Callable[[Rows], Rows]:
    compiled = [(name, to_sql(x)) for name, x in members]
    return lambda rows: rows.project([F.expr(x).alias(name) for name, x in compiled])


def _where(sql: str) -> Callable[[Rows], Rows]:
    return lambda rows: rows.with_df(rows.df.where(F.coalesce(F.expr(sql).cast("boolean"), F.lit(False))))


def _sorted(key: str, descending: bool) -> Callable[[Rows], Rows]:
    def run(rows: Rows) -> Rows:
        kept = f"{HIDDEN}key{rows.sorted_by}"
        rows = rows.with_df(rows.df.withColumn(kept, F.expr(to_sql(key))))
        return rows.sort(sort_keys(F.col(kept), rows.df.schema[kept].dataType, descending))

    return run


def _total(name: str, sql: str | None) -> Callable[[Rows], Rows]:
    if sql is None and name != "count":
        raise ExpressionError(f"${name} needs a field")
    return lambda rows: rows.one(rows.df.agg(F.expr(f"{AGGREGATES[name]}({sql or '*'})").alias("value")))


def compile_jsonata(text: str) -> Callable[[Rows], Rows]:
    steps, rest = [], text.strip()
    if m := re.fullmatch(r"\$(count|sum|average|min|max)\(\s*\$(?:\.(.+?))?\s*\)", rest, re.DOTALL):
        return _total(m[1], to_sql(m[2]) if m[2] else None)
    if m := re.match(r"\$sort\(\s*\$\s*,\s*function\s*\(\s*\$(\w+)\s*,\s*\$(\w+)\s*\)\s*\{\s*\$(\w+)\.([\w.]+)\s*([<>])\s*\$(\w+)\.([\w.]+)\s*\}\s*\)", rest):
        if m[4] != m[7] or {m[3], m[6]} != {m[1], m[2]}:
            raise ExpressionError(f"Unsupported comparator: {text}")
        # A comparator says which of the two comes later: `a > b` sorts upwards.
        steps.append(_sorted(m[4], (m[5] == "<") == (m[3] == m[1])))
        rest = rest[m.end() :].strip()
    elif rest.startswith("$"):
        rest = rest[1:].strip()
    elif not re.match(r"[\[.A-Za-z_`]", rest):
        raise ExpressionError(f"Unsupported JSONata: {text}")
    while rest:
        if rest[0] == "[":
            end = _closing(rest, 0)
            steps.append(_where(to_sql(rest[1:end])))
            rest = rest[end + 1 :].strip()
        elif m := re.match(r"\.\s*\{", rest):
            end = _closing(rest, m.end() - 1)
            steps.append(_project(_members(rest[m.end() : end])))
            rest = rest[end + 1 :].strip()
        elif m := re.fullmatch(r"\.?\s*([A-Za-z_`][\w.`]*)", rest):
            steps.append(_project([("value", m[1])]))
            rest = ""
        else:
            raise ExpressionError(f"Unsupported JSONata: {rest}")

    def run(rows: Rows) -> Rows:
        for step in steps:
            rows = step(rows)
        return rows

    return run
