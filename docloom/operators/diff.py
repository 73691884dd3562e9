"""Differences of record tables and of documents, and RFC 6902 patches.

Arrays are compared by position. A root that is replaced has the pointer "", as RFC 6901
says. Numbers are compared as they are written, objects whatever the order of their keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.errors import PatchError
from docloom.operators.nodes import Number, dump_json, parse_json
from docloom.paths import pointer, pointer_parts, ref


def diff_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op, pointer, from, value): records added or removed (pointer "") and fields
    replaced, as texts. Columns are those of both; keys must be unique."""
    fields = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys and c not in left.columns]
    null = F.lit(None).cast("string")
    text = lambda side, c, df: F.to_json(F.struct(F.col(f"{side}.`{c}`").alias("v"))) if c in df.columns else null
    joined = left.withColumn("_there", F.lit(True)).alias("l").join(right.withColumn("_there", F.lit(True)).alias("r"), [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys], "full_outer")
    known_left, known_right = F.col("l._there").isNotNull(), F.col("r._there").isNotNull()
    op = lambda name, at, a, b: F.struct(F.lit(name).alias("op"), F.lit(at).alias("pointer"), a.alias("from"), b.alias("value"))
    whole = lambda side, df: F.to_json(F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in df.columns]))
    changes = []
    for c in fields:
        if c in left.columns and c in right.columns:
            same = F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
            changes.append(F.when(~same, op("replace", pointer([c]), F.get_json_object(text("l", c, left), "$.v"), F.get_json_object(text("r", c, right), "$.v"))))
        elif c in left.columns:
            changes.append(F.when(F.col(f"l.`{c}`").isNotNull(), op("remove", pointer([c]), F.get_json_object(text("l", c, left), "$.v"), null)))
        else:
            changes.append(F.when(F.col(f"r.`{c}`").isNotNull(), op("add", pointer([c]), null, F.get_json_object(text("r", c, right), "$.v"))))
    empty = F.array().cast("array<struct<op:string,pointer:string,from:string,value:string>>")
    ops = F.when(~known_left, F.array(op("add", "", null, whole("r", right)))).when(~known_right, F.array(op("remove", "", whole("l", left), null))).otherwise(F.array_compact(F.array(*changes)) if changes else empty)
    return joined.select(*[F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k) for k in keys], F.explode(ops).alias("e")).select(*[ref(k) for k in keys], "e.*")


class Missing:
    """Stands, as the class itself, for a value that isn't there."""


def _text(value: Any) -> str | None:
    return None if value is Missing else dump_json(value)


@lru_cache(maxsize=10_000)
def _step(key: str) -> str:
    return pointer([key])


def _alike(a: Any, b: Any) -> bool:
    """Whether two values are the same leaf: such need no pointer."""
    return type(a) is type(b) and type(a) is not dict and type(a) is not list and a == b


def differences(left: Any, right: Any) -> Iterator[tuple[str, str, Any, Any]]:
    """(op, pointer, old, new) of the topmost differences, without recursion; what is removed
    comes first, from the highest index down, so that places hold."""
    stack, removed, rest = [("", left, right)], [], []
    while stack:
        at, a, b = stack.pop()
        if type(a) is dict and type(b) is dict:
            keys = [*a, *[k for k in b if k not in a]]
            below = [(k, a.get(k, Missing), b.get(k, Missing)) for k in reversed(keys)]
            stack += [(at + _step(k), x, y) for k, x, y in below if not _alike(x, y)]
        elif type(a) is list and type(b) is list:
            below = reversed(list(enumerate(zip_longest(a, b, fillvalue=Missing))))
            stack += [(f"{at}/{i}", x, y) for i, (x, y) in below if not _alike(x, y)]
        elif b is Missing:
            if a is not Missing:
                removed.append(("remove", at, a, b))
        elif a is Missing:
            rest.append(("add", at, a, b))
        elif type(a) is not type(b) or a != b:
            rest.append(("replace", at, a, b))
    yield from reversed(removed)
    yield from rest


def diff_documents(left: DataFrame, right: DataFrame, id_col: str = "id", text_col: str = "doc") -> DataFrame:
    """(id, seq, op, path, from, value): what makes the right document of an id from the
    left one. Only documents are shuffled: those of an id meet once, and equal texts go no
    further. What isn't JSON counts as missing."""
    side = lambda docs: docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("doc"))
    both = side(left).alias("l").join(side(right).alias("r"), F.col("l.id") == F.col("r.id"), "full_outer").where(~F.col("l.doc").eqNullSafe(F.col("r.doc")))
    both = both.select(F.coalesce("l.id", "r.id").alias("id"), F.col("l.doc").alias("l"), F.col("r.doc").alias("r"))
    kind = left.schema[id_col].dataType.simpleString()

    def parsed(text: str | None) -> Any:
        try:
            return Missing if text is None else parse_json(text)
        except (ValueError, RecursionError):
            return Missing

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, n, op, at, _text(old), _text(new)) for key, a, b in zip(*(batch.column(c).to_pylist() for c in ("id", "l", "r")), strict=True) for n, (op, at, old, new) in enumerate(differences(parsed(a), parsed(b)))]
            if rows:
                columns = zip(zip(*rows, strict=True), (batch.schema.field("id").type, pa.int64(), *[pa.string()] * 4), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["id", "seq", "op", "path", "from", "value"])

    return both.mapInArrow(compare, f"id {kind}, seq bigint, op string, path string, `from` string, value string")


def patches(diffs: DataFrame) -> DataFrame:
    """(id, patch): the RFC 6902 document of each id's differences."""
    op = F.concat(F.lit('{"op":'), F.to_json(F.col("op").cast("variant")), F.lit(',"path":'), F.to_json(F.col("path").cast("variant")), F.when(F.col("value").isNotNull(), F.concat(F.lit(',"value":'), F.col("value"))).otherwise(""), F.lit("}"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", op.alias("text")))), lambda x: x["text"])
    return diffs.groupBy("id").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("patch"))


# --- applying patches: a fold over one document, which is sequential by nature


def _place(parent: Any, key: str, grow: bool = False) -> Any:
    """`key` as a place in `parent`."""
    if isinstance(parent, dict):
        return key
    if not isinstance(parent, list):
        raise PatchError(f"Not a container at {key}")
    if grow and key == "-":
        return len(parent)
    if not key.isdigit() or len(key) > 1 and key[0] == "0" or int(key) >= len(parent) + grow:
        raise PatchError(f"Array index out of bounds: {key}")
    return int(key)


def read(doc: Any, at: str) -> Any:
    for key in pointer_parts(at):
        place = _place(doc, key)
        if isinstance(doc, dict) and place not in doc:
            raise PatchError(f"Path not found: {at}")
        doc = doc[place]
    return doc


def _set(doc: Any, at: str, value: Any, op: str) -> Any:
    """The document after `add`, `replace` or `remove` at a pointer."""
    keys = pointer_parts(at)
    if not keys:
        return None if op == "remove" else value
    parent = read(doc, pointer(keys[:-1]))
    place = _place(parent, keys[-1], grow=op == "add")
    if op != "add" and isinstance(parent, dict) and place not in parent:
        raise PatchError(f"Path not found: {at}")
    if op == "remove":
        del parent[place]
    elif op == "add" and isinstance(parent, list):
        parent.insert(place, value)
    else:
        parent[place] = value
    return doc


def _equal(a: Any, b: Any) -> bool:
    if isinstance(a, Number) or isinstance(b, Number):
        return isinstance(a, Number) and isinstance(b, Number) and (a == b or float(a) == float(b))
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    return a == b


def apply_patch(text: str, patch: str) -> str:
    """The document after all operations; numbers stay as they were written."""
    doc = parse_json(text)
    copied = lambda at: parse_json(dump_json(read(doc, at)))
    for op in parse_json(patch):
        name, at = op.get("op"), op.get("path")
        if name in ("add", "replace"):
            doc = _set(doc, at, op["value"], name)
        elif name == "remove":
            doc = _set(doc, at, None, name)
        elif name == "test":
            if not _equal(read(doc, at), op["value"]):
                raise PatchError(f"Test failed at {at}")
        elif name == "copy":
            doc = _set(doc, at, copied(op["from"]), "add")
        elif name == "move":
            if at.startswith(op["from"] + "/"):
                raise PatchError("A value can't move into itself")
            value = copied(op["from"])
            doc = _set(_set(doc, op["from"], None, "remove"), at, value, "add")
        else:
            raise PatchError(f"Unsupported operation: {name}")
    return dump_json(doc)


def apply_patches(docs: DataFrame, text_col: str = "doc", patch_col: str = "patch") -> DataFrame:
    """`docs` with `patched` and, where a patch doesn't apply, `error` instead. Null patches
    change nothing; null documents stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, str | None]] = []
            for text, patch in zip(batch.column(text_col).to_pylist(), batch.column(patch_col).to_pylist(), strict=True):
                try:
                    out.append((text if text is None or patch is None else apply_patch(text, patch), None))
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    out.append((None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.string()) for c in columns]], names=[*batch.schema.names, "patched", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, patched string, error string")


