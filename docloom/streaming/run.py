"""Recipes on streams. Steps on single records run in append mode as they are; distinct and
aggregate keep state; sort and merge, which need all records, run batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom import paths
from docloom.errors import OperationError
from docloom.operators.rows import Rows
from docloom.operators.steps import STEPS
from docloom.plans.compiler import compile_recipe, run_recipe
from docloom.plans.recipe import Recipe
from docloom.semantics import UNDEFINED, comparable, exact

#: Steps that look at one record at a time.
NARROW = frozenset(("filter", "map", "pick", "remove", "rename", "add", "replace", "regex", "type-convert", "extract", "flatten", "unflatten", "validate", "jq"))


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def stream_recipe(df: DataFrame, recipe: Recipe, event_time: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """A streaming frame after the recipe. With an event time, distinct forgets keys after
    the watermark, so its state is bounded."""
    if event_time:
        df = df.withWatermark(event_time, watermark)
    compile_recipe(recipe)  # all errors before anything starts
    for step in recipe.steps:
        if not step.enabled:
            continue
        if step.type in NARROW or step.type == "join" and isinstance(step.config.get("right"), list):
            rows = STEPS[step.type](step.config)(Rows(df, ()))
            df = rows.df
        elif step.type in ("distinct", "deduplicate"):
            key = step.config.get("key")
            if key and paths.find(df.schema, key) is None:
                raise OperationError(f"No field {key}")
            by = paths.parts(key)[:1] if key else df.columns
            if key and len(paths.parts(key)) > 1:
                raise OperationError("distinct on streams takes a top-level key")
            df = df.dropDuplicatesWithinWatermark(by) if event_time else df.dropDuplicates(by)
        elif step.type == "group":
            found = paths.find(df.schema, step.config.get("key", ""))
            name = F.lit("") if found is None else comparable(*found)
            df = df.withColumn("group_key", F.when(name == "", UNDEFINED).otherwise(name))
        elif step.type == "aggregate":
            df = _aggregate(df, step.config)
        else:
            raise OperationError(f"{step.type} needs all records: use start_batches")
    return df


def _aggregate(df: DataFrame, config: dict) -> DataFrame:
    """The running value; written in update or complete mode."""
    found = paths.find(df.schema, config["field"]) if config.get("field") else None
    if config["operation"] == "count":
        return df.agg((F.count("*") if found is None else F.count(found[0])).alias("value"))
    if found is None:
        raise OperationError(f"No field {config.get('field')}")
    make = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[config["operation"]]
    return df.agg(make(exact(*found)).alias("value"))


def windowed_counts(df: DataFrame, event_time: str, width: str, keys: tuple[str, ...] = (), slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding window and keys; what comes after the watermark is left out."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return df.withWatermark(event_time, watermark).groupBy(window, *keys).agg(F.count("*").alias("n"))


def start_batches(df: DataFrame, recipe: Recipe, sink: Callable[[DataFrame, int], None], checkpoint: str, order: list[str] | None = None, once: bool = False) -> StreamingQuery:
    """Runs any recipe on each micro-batch by itself, and hands the result to `sink`."""
    compile_recipe(recipe)
    writer = df.writeStream.foreachBatch(lambda batch, n: sink(run_recipe(batch, recipe, order), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
