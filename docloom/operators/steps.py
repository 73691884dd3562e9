"""The native steps of recipes, each compiled to DataFrame operations.

A compiler takes a step's configuration, refuses what is wrong with it at once, and returns
a function from records to records. Nothing is run or collected here.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import paths
from docloom.errors import OperationError
from docloom.functions.regex import replace_regex
from docloom.operators.rows import HIDDEN, INDEX, Rows
from docloom.paths import ref
from docloom.semantics import UNDEFINED, as_number, comparable, compact, exact, identical, is_nested, is_number, literal, sort_keys

Transform = Callable[[Rows], Rows]
Compiler = Callable[[dict[str, Any]], Transform]
STEPS: dict[str, Compiler] = {}


def register_step(*names: str) -> Callable[[Compiler], Compiler]:
    """Make a compiler known under these step types; users may add their own."""

    def add(compiler: Compiler) -> Compiler:
        STEPS.update(dict.fromkeys(names, compiler))
        return compiler

    return add


def _text(config: dict, *names: str, default: str | None = None) -> str:
    for name in names:
        if name in config:
            if not isinstance(config[name], str):
                raise OperationError(f"{name}: text is needed")
            return config[name]
    if default is None:
        raise OperationError(f"{names[0]}: text is needed")
    return default


def _path(config: dict, *names: str) -> str:
    path = _text(config, *names)
    if not paths.parts(path):
        raise OperationError(f"{names[0]}: a path is needed")
    return path


def _names(config: dict, name: str) -> list[str]:
    value = config.get(name)
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise OperationError(f"{name}: a list of field names is needed")
    return list(dict.fromkeys(value))


def _edit(f: Callable[[DataFrame], DataFrame]) -> Transform:
    """`f` on records with their hidden columns, which it leaves last."""
    return lambda rows: rows.with_df(f(rows.df))


@register_step("filter")
def filter_(config: dict) -> Transform:
    """{field, equals}: records whose value is `equals`; without `equals` those without the
    field. {field, exists}: records with or without it."""
    field = _path(config, "field")
    exists = config.get("exists")
    if "exists" in config and not isinstance(exists, bool):
        raise OperationError("exists: true or false is needed")

    def run(rows: Rows) -> Rows:
        found = paths.find(rows.df.schema, field)
        if exists is not None:
            there = F.lit(False) if found is None else found[0].isNotNull()
            return rows.with_df(rows.df.where(there if exists else ~there))
        return rows.with_df(rows.df.where(identical(found, config.get("equals"), "equals" in config)))

    return run


@register_step("map")
def map_(config: dict) -> Transform:
    """{mapping: {target: source}}: new records of the sources that exist."""
    mapping = config.get("mapping")
    if not isinstance(mapping, dict) or not all(isinstance(v, str) for v in mapping.values()):
        raise OperationError("mapping: target fields with source paths are needed")

    def run(rows: Rows) -> Rows:
        tree: dict[str, Any] = {}
        for target, source in mapping.items():
            if (found := paths.find(rows.df.schema, source)) is not None and paths.parts(target):
                *above, last = paths.parts(target)
                node = tree
                for name in above:
                    if not isinstance(node.get(name), dict):
                        node[name] = {}
                    node = node[name]
                node[last] = found[0]
        return rows.project([column.alias(name) for name, column in _tree(tree)])

    return run


def _tree(tree: dict[str, Any]) -> list[tuple[str, Column]]:
    return [(n, F.struct(*[c.alias(m) for m, c in _tree(x)]) if isinstance(x, dict) else x) for n, x in tree.items()]


@register_step("pick")
def pick(config: dict) -> Transform:
    """{fields}: these top-level fields, in this order."""
    fields = _names(config, "fields")
    return lambda rows: rows.project([ref(f) for f in fields if f in rows.fields])


@register_step("remove")
def remove(config: dict) -> Transform:
    """{fields}: all but these top-level fields."""
    fields = set(_names(config, "fields"))
    return lambda rows: rows.project([ref(f) for f in rows.fields if f not in fields])


@register_step("rename")
def rename(config: dict) -> Transform:
    """{from, to}: the value moves to `to`, last of all, over what was there."""
    old, new = _path(config, "from"), _path(config, "to")

    def run(df: DataFrame) -> DataFrame:
        found = paths.find(df.schema, old)
        if found is None:
            return df
        kept = f"{HIDDEN}moved"
        df = paths.cut(df.withColumn(kept, found[0]), old)
        if len(paths.parts(new)) == 1 or paths.find(df.schema, new) is not None:
            df = paths.cut(df, new)
        return paths.put(df, new, F.col(kept)).drop(kept)

    return _edit(run)


@register_step("add")
def add(config: dict) -> Transform:
    """{key, value}: a constant under this very name."""
    key, value = _text(config, "key", "field"), config.get("value")

    def run(rows: Rows) -> Rows:
        new = literal(value).alias(key)
        columns = [new if f == key else ref(f) for f in rows.fields]
        return rows.project(columns if key in rows.fields else [*columns, new])

    return run


@register_step("replace")
def replace(config: dict) -> Transform:
    """{field, from, to}: `to` where the value is `from`; without `from` where it is missing.
    A column that then holds values of two types becomes text."""
    field, to = _path(config, "field"), config.get("to")

    def run(df: DataFrame) -> DataFrame:
        found = paths.find(df.schema, field)
        hit = identical(found, config.get("from"), "from" in config)
        if found is None:
            return paths.put(df, field, F.when(hit, literal(to))) if "from" not in config else df
        col, kind = found
        new = literal(to)
        if to is None:
            new = F.lit(None).cast(kind)
        elif isinstance(to, str) != isinstance(kind, T.StringType) or isinstance(to, bool) != isinstance(kind, T.BooleanType):
            col, new = (F.to_json(col) if is_nested(kind) else col.cast("string")), F.lit(to if isinstance(to, str) else compact(to))
        return paths.put(df, field, F.when(hit, new).otherwise(col))

    return _edit(run)


@register_step("regex")
def regex(config: dict) -> Transform:
    """{field, pattern, replacement, flags}: on texts only; without flag g the first match."""
    field, pattern = _path(config, "field"), _text(config, "pattern")
    change = replace_regex(pattern, _text(config, "replacement", default=""), _text(config, "flags", default="g"))

    def run(df: DataFrame) -> DataFrame:
        found = paths.find(df.schema, field)
        return df if found is None or not isinstance(found[1], T.StringType) else paths.put(df, field, change(found[0]))

    return _edit(run)


@register_step("type-convert")
def type_convert(config: dict) -> Transform:
    """{field, target}: to string, number, boolean or null. A text that is no number fails;
    numbers become booleans by being other than 0; a missing field is added as null."""
    field, target = _path(config, "field"), config.get("target")
    if target not in ("string", "number", "boolean", "null"):
        raise OperationError(f"cannot convert to {target!r}")

    def run(df: DataFrame) -> DataFrame:
        found = paths.find(df.schema, field)
        if found is None or target == "null":
            return paths.put(df, field, F.lit(None).cast("string"))
        col, kind = found
        if target == "string":
            new = F.to_json(col) if is_nested(kind) else col.cast("string")
        elif target == "boolean":
            truth = F.lower(col) == "true" if isinstance(kind, T.StringType) else col != 0 if is_number(kind) else col if isinstance(kind, T.BooleanType) else col.isNotNull()
            new = F.coalesce(truth, F.lit(False))
        elif is_number(kind):
            new = col
        elif isinstance(kind, T.BooleanType):
            new = col.cast("int")
        else:
            text = F.trim(comparable(col, kind))
            new = F.when(as_number(text).isNotNull(), text.cast("double")).when(col.isNotNull(), F.raise_error(F.concat(F.lit(f"Not a number in {field}: "), text)).cast("double"))
        return paths.put(df, field, new)

    return _edit(run)


@register_step("extract")
def extract(config: dict) -> Transform:
    """{path, as}: records of one field."""
    path, name = _path(config, "path", "field"), _text(config, "as", default="value")
    return lambda rows: rows.project([paths.get(rows.df.schema, path).alias(name)])


@register_step("sort")
def sort(config: dict) -> Transform:
    """{key, direction}: stable; null and missing first, last if descending."""
    key, direction = _path(config, "key", "field"), config.get("direction", "asc")
    if direction not in ("asc", "desc"):
        raise OperationError("direction must be asc or desc")

    def run(rows: Rows) -> Rows:
        found = paths.find(rows.df.schema, key)
        if found is None:
            return rows
        kept = f"{HIDDEN}key{rows.sorted_by}"  # the order lasts when the field is removed
        rows = rows.with_df(rows.df.withColumn(kept, found[0]))
        return rows.sort(sort_keys(F.col(kept), found[1], direction == "desc"))

    return run


@register_step("distinct", "deduplicate")
def distinct(config: dict) -> Transform:
    """{key}: the first record of each value, or of each whole record."""
    key = _text(config, "key", "field", default="") or None

    def run(rows: Rows) -> Rows:
        if key is not None:
            found = paths.find(rows.df.schema, key)
            by = [F.lit(0)] if found is None else [F.to_json(found[0]) if is_nested(found[1]) else found[0]]
        else:
            by = [F.to_json(ref(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else ref(f.name) for f in rows.schema()]
        if rows.sorted_by:
            place = f"{HIDDEN}place"
            first = rows.df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*rows.by())))
            return rows.scattered(first.where(F.col(place) == 1).drop(place))
        # By the index alone the first record is an aggregate, which sums up before it shuffles.
        index = rows.hidden[0]
        record = F.struct(*[ref(c) for c in rows.df.columns])
        first = rows.df.groupBy(*[c.alias(f"{HIDDEN}by{i}") for i, c in enumerate(by)]).agg(F.min_by(record, index).alias("r"))
        return rows.scattered(first.select(*[F.col("r").getField(c).alias(c) for c in rows.df.columns]))

    return run


@register_step("group")
def group(config: dict) -> Transform:
    """{key, shape}: long (the records with their `group_key`, ordered by it; no group is
    ever gathered), or nested (one row per key with the array of its `records`, for groups
    that fit a task). Missing, null and empty keys are one group."""
    key, shape = _path(config, "key", "field"), config.get("shape", "long")
    if shape not in ("long", "nested"):
        raise OperationError("shape must be long or nested")

    def run(rows: Rows) -> Rows:
        found = paths.find(rows.df.schema, key)
        text = F.lit("") if found is None else comparable(*found)
        name = F.when(text == "", UNDEFINED).otherwise(text).alias("group_key")
        if shape == "long":
            kept = f"{HIDDEN}key{rows.sorted_by}"
            rows = rows.with_df(rows.df.withColumn(kept, name))
            grouped = rows.project([F.col(kept).alias("group_key"), *[ref(f) for f in rows.fields if f != "group_key"]])
            return grouped.sort([(F.col(kept), False)])
        record = F.struct(*[ref(f) for f in rows.fields])
        if rows.sorted_by:
            place = F.row_number().over(Window.partitionBy(name).orderBy(*rows.by()))
            ranked = rows.df.select(name, place.alias("at"), record.alias("r"))
        else:
            ranked = rows.df.select(name, rows.hidden[0].alias("at"), record.alias("r"))
        pairs = F.array_sort(F.collect_list(F.struct("at", "r")), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
        return rows.one(ranked.groupBy("group_key").agg(F.transform(pairs, lambda p: p["r"]).alias("records")).orderBy("group_key"))

    return run


def _leaves(col: Column, kind: T.DataType, name: str, separator: str) -> list[tuple[str, Column]]:
    if not isinstance(kind, T.StructType):
        return [(name, col)]
    return [x for n in kind.names for x in _leaves(col.getField(n), kind[n].dataType, f"{name}{separator}{n}", separator)]


@register_step("flatten")
def flatten(config: dict) -> Transform:
    """{separator}: nested objects to fields with joined names; arrays stay; a later field
    of the same name wins."""
    separator = _text(config, "separator", default=".")

    def run(rows: Rows) -> Rows:
        found = dict(x for f in rows.schema() for x in _leaves(ref(f.name), f.dataType, f.name, separator))
        return rows.project([c.alias(n) for n, c in found.items()])

    return run


@register_step("unflatten")
def unflatten(config: dict) -> Transform:
    """{separator}: fields with joined names to nested objects; dots split names too; what
    stands in the way of a later field is replaced."""
    separator = _text(config, "separator", default=".")

    def run(rows: Rows) -> Rows:
        tree: dict[str, Any] = {}
        for f in rows.fields:
            *above, last = [p for piece in f.split(separator) for p in piece.split(".") if p] or [f]
            node = tree
            for name in above:
                if not isinstance(node.get(name), dict):
                    node[name] = {}
                node = node[name]
            node[last] = ref(f)
        return rows.project([c.alias(n) for n, c in _tree(tree)])

    return run


@register_step("merge")
def merge(config: dict) -> Transform:
    """{}: one record of all, where the last value of each field wins. Null is no value here,
    except in VARIANT."""

    def run(rows: Rows) -> Rows:
        if rows.sorted_by:  # of each field the value of the last record that has one
            last = [rows.df.where(ref(f).isNotNull()).orderBy(*rows.by(backwards=True)).limit(1).select(ref(f)) for f in rows.fields]
            out = rows.df.sparkSession.range(1)
            for one in last:  # of one row each
                out = out.join(F.broadcast(one), F.lit(True), "left")
            return rows.one(out.drop("id") if "id" not in rows.fields else out.select(*[one[f] for one, f in zip(last, rows.fields, strict=True)]))
        index = rows.hidden[0]
        return rows.one(rows.df.agg(*[F.max_by(ref(f), F.when(ref(f).isNotNull(), index)).alias(f) for f in rows.fields]))

    return run


@register_step("join")
def join(config: dict) -> Transform:
    """{leftKey, rightKey, right, as}: each record with the last record of `right` of the
    same key, or null, under `as`. `right` is a list of records, which is broadcast, or the
    name of a table, for which Catalyst picks the join. Null matches null."""
    left_key, right_key, name = _path(config, "leftKey"), _path(config, "rightKey"), _text(config, "as", default="joined")
    right = config.get("right")
    if not isinstance(right, (list, str)) or isinstance(right, list) and not all(isinstance(r, dict) for r in right):
        raise OperationError("right: a list of records or the name of a table is needed")

    def run(rows: Rows) -> Rows:
        if right == []:
            return rows.project([*[ref(f) for f in rows.fields if f != name], F.lit(None).cast("string").alias(name)])
        if isinstance(right, list):
            text = F.lit(compact(right))
            table = rows.df.sparkSession.range(1).select(F.inline(F.from_json(text, F.schema_of_json(text))))
        else:
            if right not in rows.tables:
                raise OperationError(f"No table {right}")
            table = rows.tables[right]
        found, own = paths.find(table.schema, right_key), paths.find(rows.df.schema, left_key)
        if found is None or own is None or is_number(found[1]) != is_number(own[1]):
            return rows.project([*[ref(f) for f in rows.fields if f != name], F.lit(None).cast(table.schema).alias(name)])
        key, at = f"{HIDDEN}right", f"{HIDDEN}at"
        table = table.select(found[0].alias(key), F.monotonically_increasing_id().alias(at), F.struct(*[ref(c) for c in table.columns]).alias(name))
        table = table.groupBy(key).agg(F.max_by(name, at).alias(name))
        table = F.broadcast(table) if isinstance(right, list) else table
        left = rows.df.select(*[ref(c) for c in rows.df.columns if c != name])
        put = rows.with_df if isinstance(right, list) else rows.scattered  # a broadcast keeps the order
        return put(left.join(table, own[0].eqNullSafe(F.col(key)), "left").select(*[ref(f) for f in rows.fields if f != name], name, *rows.hidden))

    return run


@register_step("aggregate")
def aggregate(config: dict) -> Transform:
    """{operation, field}: one record {value}. count: values that aren't null. sum, avg, min
    and max: of numbers only, summed exactly; none gives null."""
    operation, field = config.get("operation"), _text(config, "field", default="") or None
    if operation not in ("count", "sum", "avg", "min", "max"):
        raise OperationError(f"no aggregate called {operation!r}")

    def run(rows: Rows) -> Rows:
        found = paths.find(rows.df.schema, field) if field else None
        if operation == "count":
            value = F.count("*") if field is None else F.lit(0).cast("long") if found is None else F.count(found[0])
        elif found is None:
            value = F.max(F.lit(None).cast("decimal(38,0)"))
        else:
            number = exact(*found)
            value = F.sum(number).cast("double") / F.count(number) if operation == "avg" else {"sum": F.sum, "min": F.min, "max": F.max}[operation](number)
            if operation == "avg":
                value = F.when(F.count(number) > 0, value)
        return rows.one(rows.df.agg(value.alias("value")))

    return run


@register_step("validate")
def validate(config: dict) -> Transform:
    """{fields}: fails on a record that lacks one of these, and says where the source has it;
    else changes nothing. Typed rows hold missing as null, so null fails in them; in VARIANT it
    passes."""
    fields = _names(config, "fields")

    def run(rows: Rows) -> Rows:
        lacking = F.concat_ws(", ", *[F.when(paths.get(rows.df.schema, f).isNull(), F.lit(f)) for f in fields])
        place = F.to_json(F.struct(F.col(INDEX).alias("record")))
        failed = F.raise_error(F.concat(F.lit("A record is missing required fields: "), lacking, F.lit(", at "), place)).cast("boolean")
        return rows.with_df(rows.df.where(F.when(lacking == "", True).otherwise(failed))) if fields else rows

    return run


def missing_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """How many records lack each field: the report of what `validate` refuses."""
    counts = df.agg(*[F.count(F.when(paths.get(df.schema, f).isNull(), 1)).alias(f"c{i}") for i, f in enumerate(fields)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("missing")) for i, f in enumerate(fields)])).alias("e")).select("e.*")


@register_step("jq")
def jq(config: dict) -> Transform:
    from docloom.functions.jq import compile_jq

    return compile_jq(_text(config, "expression", default="."))


@register_step("jsonata")
def jsonata(config: dict) -> Transform:
    from docloom.functions.jsonata import compile_jsonata

    return compile_jsonata(_text(config, "expression"))
