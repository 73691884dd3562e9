"""The node table: one row per value and property of JSON documents.

Documents are texts. Each is parsed where it is read, strictly (RFC 8259; the last of equal
keys wins) and without touching a number: `raw` is its text as written. Everything about
structure is then plain relational work on these rows.

Columns: `id` of the document, `seq` (place in document order), `pointer`, `parent`
(null for the root), `gpath` (indices as `[*]`), `depth`, `kind` (object, array or value),
`key` (null outside objects), `type`, `raw` (compact JSON; null for containers), `text`
(the decoded string), `size` (of containers) and `error` (the only column of a document
that isn't JSON, besides its id).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.paths import member, pointer
from docloom.semantics import compact

FIELDS = ("seq bigint", "pointer string", "parent string", "gpath string", "depth int", "kind string", "key string", "type string", "raw string", "text string", "size int", "error string")
#: Nodes that a task hands on at once.
BATCH = 10_000


class Number(str):
    """A number as it is written."""


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)


def parse_json(text: str) -> Any:
    """Strict, with numbers kept as text."""
    return _DECODER.decode(text.removeprefix("\ufeff"))


def dump_json(value: Any, pretty: bool = False, depth: int = 0) -> str:
    """What `parse_json` took, with every number as it was."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, (dict, list)) and value:
        pad, end = ("\n" + "  " * (depth + 1), "\n" + "  " * depth) if pretty else ("", "")
        if isinstance(value, dict):
            items = [f"{compact(k)}:{' ' if pretty else ''}{dump_json(v, pretty, depth + 1)}" for k, v in value.items()]
        else:
            items = [dump_json(v, pretty, depth + 1) for v in value]
        return "{["[isinstance(value, list)] + pad + f",{pad}".join(items) + end + "}]"[isinstance(value, list)]
    return compact(value)


TYPES = {dict: "object", list: "array", bool: "boolean", Number: "number", str: "string", type(None): "null"}


def type_of(value: Any) -> str:
    return TYPES[type(value)]


@lru_cache(maxsize=10_000)
def _steps(key: str) -> tuple[str, str]:
    """How a pointer and a generalised path go on to a member."""
    return pointer([key]), member(key)


def walk(value: Any) -> Iterator[tuple]:
    """The nodes of a parsed document in document order, without recursion."""
    stack: list[tuple[Any, str, str | None, str, int, str | None]] = [(value, "", None, "$", 0, None)]
    seq = 0
    while stack:
        v, here, parent, gpath, depth, key = stack.pop()
        kind = type_of(v)
        if kind == "object":
            yield seq, here, parent, gpath, depth, kind, key, kind, None, None, len(v), None
            for k in reversed(v):
                at, on = _steps(k)
                stack.append((v[k], here + at, here, gpath + on, depth + 1, k))
        elif kind == "array":
            yield seq, here, parent, gpath, depth, kind, key, kind, None, None, len(v), None
            stack += [(v[i], f"{here}/{i}", here, f"{gpath}[*]", depth + 1, None) for i in range(len(v) - 1, -1, -1)]
        else:
            yield seq, here, parent, gpath, depth, "value", key, kind, str(v) if kind == "number" else compact(v), v if kind == "string" else None, None, None
        seq += 1


def node_table(docs: DataFrame, id_col: str = "id", text_col: str = "doc", columns: tuple[str, ...] | None = None) -> DataFrame:
    """The nodes of all documents, or only their `columns`, as Spark can't tell the parser
    which are wanted. Null texts have none."""
    kind = docs.schema[id_col].dataType.simpleString()
    every = ["id", *[f.split(" ")[0] for f in FIELDS]]
    names = [n for n in every if columns is None or n in columns]
    wanted = [every.index(n) for n in names]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(0).type, *[arrow[f.split(" ")[1]] for f in FIELDS]]
            rows: list[tuple] = []

            def flush(rows: list[tuple], types: list[pa.DataType] = types) -> pa.RecordBatch:
                found = list(zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(found[i], types[i]) for i in wanted], names=names)

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                try:
                    value = parse_json(text)
                except (ValueError, RecursionError) as e:
                    rows.append((key, *[None] * (len(FIELDS) - 1), str(e)))
                    continue
                for node in walk(value):
                    rows.append((key, *node))
                    if len(rows) >= BATCH:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("doc")).mapInArrow(run, ", ".join(x for x in (f"id {kind}", *FIELDS) if x.split(" ")[0] in names))
