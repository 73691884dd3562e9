"""What the node table tells about structure: profile, fields, schema, index, search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.paths import member, ref
from docloom.semantics import is_nested

SCHEMA_URI = "https://json-schema.org/draft/2020-12/schema"


def profile(nodes: DataFrame, events: bool = False) -> DataFrame:
    """One row: documents, objects, arrays, primitives, max_depth (of containers, the root 0),
    and, if wanted, `events` as `event_count` has it, found in the same pass."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return nodes.where("error is null").agg(
        F.count_if(F.col("parent").isNull()).alias("documents"),
        n("object").alias("objects"),
        n("array").alias("arrays"),
        n("value").alias("primitives"),
        F.coalesce(F.max(F.when(F.col("kind") != "value", F.col("depth"))), F.lit(0)).alias("max_depth"),
        *[_events()] * events,
    )


def primitive_types(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'value'").groupBy("type").agg(F.count("*").alias("n"))


def depth_counts(nodes: DataFrame) -> DataFrame:
    """Containers by depth."""
    return nodes.where("kind in ('object', 'array')").groupBy("depth").agg(F.count("*").alias("n"))


def array_lengths(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'array'").groupBy(F.col("size").alias("length")).agg(F.count("*").alias("n"))


def property_counts(nodes: DataFrame) -> DataFrame:
    """Property names, with how often each stands in a document."""
    return nodes.where("key is not null").groupBy(F.col("key").alias("field")).agg(F.count("*").alias("n"))


def _events() -> Column:
    steps = F.when(F.col("kind") == "value", 1).otherwise(2) + F.col("key").isNotNull().cast("int")
    return F.coalesce(F.sum(steps), F.lit(0)).alias("events")


def event_count(nodes: DataFrame) -> DataFrame:
    """One row: `events`, the steps of a walk that enters and leaves each container and meets
    each property name and each primitive value."""
    return nodes.where("error is null").agg(_events())


def top_fields(nodes: DataFrame, most: int = 40, examples: int = 3) -> DataFrame:
    """The fields that occur most often, ties by name."""
    return field_stats(nodes, examples).orderBy(F.desc("occurrences"), "field").limit(most)


def field_stats(nodes: DataFrame, examples: int = 3) -> DataFrame:
    """Per property name, at whatever depth: occurrences, missing (objects without it), the
    types of its primitive values, whether they are several, and its first examples (which
    take a pass of their own, unless there are to be none)."""
    value = F.col("kind") == "value"
    # The null key's row counts what has no name: it holds the root's and elements' objects.
    every = nodes.groupBy("key").agg(F.count("*").alias("occurrences"), F.count_if(F.col("kind") == "object").alias("n"), F.array_sort(F.collect_set(F.when(value, F.col("type")))).alias("types"))
    every = every.persist()  # a row per name; both its uses read it, so that documents are parsed once
    objects = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("objects"))  # one row
    out = every.where("key is not null").crossJoin(F.broadcast(objects))
    if examples:
        named = nodes.where("key is not null")
        # Ranks are limited in every task before they are shuffled, so a common name is no burden.
        place = F.row_number().over(Window.partitionBy("key").orderBy("id", "seq"))
        first = named.where("kind = 'value' and type <> 'null'").select("key", "raw", place.alias("place")).where(F.col("place") <= examples)
        first = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw"))), lambda x: x["raw"]).alias("examples"))
        out = out.join(first, "key", "left")
    else:
        out = out.withColumn("examples", F.lit(None).cast("array<string>"))
    return out.select(F.col("key").alias("field"), "occurrences", (F.col("objects") - F.col("occurrences")).alias("missing"), "types", (F.size("types") > 1).alias("inconsistent"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def infer_schema(nodes: DataFrame, examples: int = 3) -> DataFrame:
    """Per generalised path: sorted types, count, the first string and the first distinct
    ones. Keys that are no plain names are quoted in the path, so that no two paths meet."""
    good = nodes.where("error is null")
    paths = good.groupBy("gpath").agg(
        F.array_sort(F.collect_set("type")).alias("types"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_set("key")).alias("keys"),
        F.min_by("text", F.when(F.col("type") == "string", F.struct("id", "seq"))).alias("example"),
    )
    texts = good.where("type = 'string'").groupBy("gpath", "text").agg(F.min(F.struct("id", "seq")).alias("at"))
    first = texts.withColumn("r", F.row_number().over(Window.partitionBy("gpath").orderBy("at"))).where(F.col("r") <= examples)
    first = first.groupBy("gpath").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]).alias("examples"))
    return paths.join(first, "gpath", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def json_schema(nodes: DataFrame) -> dict:
    """JSON Schema 2020-12 of all documents. Its size is that of the schema: one row per
    distinct path comes to the driver."""
    rows = {r["gpath"]: r for r in infer_schema(nodes).select("gpath", "types", "keys").toLocalIterator()}
    if not rows:
        return {"$schema": SCHEMA_URI}
    members: dict[str, list[str]] = {}
    for path in sorted(rows):
        if rows[path]["keys"]:
            members.setdefault(path[: -len(member(rows[path]["keys"][0]))], []).append(path)

    def build(path: str) -> dict:
        types = list(rows[path]["types"])
        out: dict = {"type": types[0] if len(types) == 1 else types}
        if "object" in types:
            out["properties"] = {rows[p]["keys"][0]: build(p) for p in members.get(path, [])}
        if "array" in types and f"{path}[*]" in rows:
            out["items"] = build(f"{path}[*]")
        return out

    return {"$schema": SCHEMA_URI, **build("$")}


def structure_index(nodes: DataFrame, most: int = 100_000) -> tuple[DataFrame, bool]:
    """(the first entries by document and place, whether there are more)."""
    index = nodes.where("error is null").select("id", "seq", "pointer", "depth", "kind", "key", "type", "raw")
    return index.orderBy("id", "seq").limit(most), index.limit(most + 1).count() > most


def lookup(nodes: DataFrame, at: str) -> DataFrame:
    """The nodes at a pointer."""
    return nodes.where(F.col("pointer") == at)


def _matches(text: Column, query: str, regex: bool) -> Column:
    if regex:
        try:
            re.compile(query)
            return text.rlike(f"(?i){query}")
        except re.error:
            pass  # as plain text then
    return F.lower(text).contains(query.lower())


def search(nodes: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Nodes whose pointer, key or text match, and all their ancestors."""
    text = F.concat_ws(" ", "pointer", "key", "raw")
    hits = nodes.where(_matches(text, query, regex)).select("id", "pointer")
    steps = F.split("pointer", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    shown = hits.select("id", F.explode(above).alias("pointer")).distinct()
    return nodes.join(shown, ["id", "pointer"], "left_semi")


def search_records(df: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Records whose compact JSON matches; an invalid regular expression matches none."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    if regex:
        try:
            re.compile(query)
        except re.error:
            return df.where(F.lit(False))
        return df.where(text.rlike(f"(?i){query}"))
    return df.where(_matches(text, query, False))


def sort_by_text(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Records by what a table shows in `column`: its text, or the compact JSON of nested
    values, in order of code points; null is shown as `null`."""
    value = ref(column)
    text = F.to_json(value) if is_nested(df.schema[column].dataType) else value.cast("string")
    shown = F.coalesce(text, F.lit("null"))
    return df.orderBy(shown.desc() if descending else shown.asc())


def embedded_json(df: DataFrame, column: str, most: int | None = 100) -> DataFrame:
    """Records whose text in `column` is itself a JSON object or array, as VARIANT `value`."""
    text = F.col(column)
    value = F.when(text.rlike(r"^\s*[\[{]"), F.try_parse_json(text))
    found = df.withColumn("value", value).where(F.col("value").isNotNull())
    return found if most is None else found.limit(most)


def embedded_nodes(nodes: DataFrame) -> DataFrame:
    """String nodes that hold JSON objects or arrays, with their pointers."""
    return embedded_json(nodes.where("type = 'string'"), "text", None).select("id", "pointer", "text", F.to_json("value").alias("value"))


def column_union(*frames: DataFrame) -> DataFrame:
    """All rows under the union of the columns, in order of first appearance."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


