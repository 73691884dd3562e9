"""Sources: JSON, JSON Lines, delimited text and Parquet, typed, raw or as VARIANT."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.nodes import dump_json, parse_json
from docloom.operators.rows import INDEX

SAMPLE = 64 * 1024


def detect_format(name: str, sample: str) -> str:
    """json or jsonl. Blank text is json; the name's ending decides; else it is jsonl if
    there are several lines and the first of up to 20 are JSON each, three at least."""
    if not sample.strip():
        return "json"
    lower = name.lower()
    if lower.endswith((".jsonl", ".ndjson")):
        return "jsonl"
    if lower.endswith(".json"):
        return "json"
    lines = [x for x in sample.splitlines() if x.strip()]
    good = 0
    for line in lines[:20]:
        try:
            json.loads(line)
        except ValueError:
            break
        good += 1
    return "jsonl" if len(lines) > 1 and good >= min(len(lines), 3) else "json"


def _head(spark: SparkSession, path: str) -> str:
    """The first lines, by Spark's reader, so that any file system will do."""
    lines = spark.read.text(path).limit(21).collect()
    return "\n".join(r[0][:SAMPLE] for r in lines)[:SAMPLE]


def file_format(spark: SparkSession, path: str) -> str:
    lower = path.rstrip("/").lower().removesuffix(".gz")
    for end in ("csv", "tsv", "parquet", "json", "jsonl", "ndjson"):
        if lower.endswith(f".{end}"):
            return "jsonl" if end == "ndjson" else end
    return detect_format(path, _head(spark, path))


def indexed(df: DataFrame) -> DataFrame:
    """`df` with the hidden index of file order: file, block, and place in it."""
    meta = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(INDEX, meta)


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None, exact: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Typed records with the hidden index. `exact` reads every primitive as its own text.
    A bad record fails the read; mode PERMISSIVE keeps it in `_corrupt_record` instead."""
    fmt = fmt or file_format(spark, path)
    reader = spark.read.option("mode", mode)
    if schema:
        reader = reader.schema(schema)
    if fmt in ("json", "jsonl"):
        reader = reader.option("multiLine", fmt == "json").option("primitivesAsString", exact).option("prefersDecimal", not exact)
        return indexed(reader.json(path))
    if fmt in ("csv", "tsv"):
        return indexed(reader.option("header", True).option("sep", "," if fmt == "csv" else "\t").option("escape", '"').option("multiLine", True).option("inferSchema", schema is None).csv(path))
    if fmt == "parquet":
        return indexed(spark.read.parquet(path))
    raise ValueError(f"Unsupported format: {fmt}")


def read_variant(spark: SparkSession, path: str, fmt: str | None = None, column: str = "value") -> DataFrame:
    """One VARIANT per record: fields need no schema, and null isn't missing."""
    fmt = fmt or file_format(spark, path)
    return indexed(spark.read.option("multiLine", fmt == "json").option("singleVariantColumn", column).json(path))


def read_texts(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(id, doc): documents byte for byte. JSON Lines has one per line that isn't blank."""
    fmt = fmt or file_format(spark, path)
    raw = spark.read.text(path, wholetext=fmt == "json")
    doc = F.regexp_replace("value", "\r$", "").alias("doc")
    return raw.where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("id"), doc)


@dataclass(frozen=True)
class Preview:
    """What is shown before a source is read in full."""

    format: str
    text: str
    records: DataFrame


def preview(spark: SparkSession, path: str, fmt: str | None = None, most: int = 1000) -> Preview:
    """The format, the first lines of a text source, and its first `most` records."""
    fmt = fmt or file_format(spark, path)
    return Preview(fmt, "" if fmt == "parquet" else _head(spark, path), read(spark, path, fmt).limit(most))


def bad_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, offset, text) of the lines of a JSON Lines source that aren't JSON: how many
    records the file has before, and the byte at which the line begins.

    Files are counted by blocks; only blocks that hold a bad line are put in order."""
    raw = indexed(spark.read.option("lineSep", "\n").text(path)).select(f"{INDEX}.*", F.regexp_replace("value", "\r$", "").alias("text"), (F.octet_length("value") + 1).alias("bytes"))
    lines = raw.withColumn("full", (F.trim("text") != "").cast("int")).withColumn("bad", (F.col("full") == 1) & F.try_parse_json("text").isNull())
    block = ["file", "block"]
    counts = lines.groupBy(*block).agg(F.sum("full").alias("full"), F.sum("bytes").alias("bytes"), F.max("bad").alias("bad"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*block, "bad", *[F.coalesce(F.sum(c).over(in_file), F.lit(0)).alias(f"{c}_before") for c in ("full", "bytes")]).where("bad").drop("bad")
    in_block = Window.partitionBy(*block).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = {c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(in_block), F.lit(0)) for c in ("full", "bytes")}
    found = lines.join(starts, block).select("file", before["full"].alias("record"), before["bytes"].alias("offset"), "text", "bad")
    return found.where("bad").drop("bad")


def count_records(spark: SparkSession, path: str) -> int:
    """Records of a JSON Lines source, each parsed in full but none kept."""
    return spark.read.option("mode", "FAILFAST").option("singleVariantColumn", "v").json(path).agg(F.count("v")).first()[0]


def read_pasted(spark: SparkSession, text: str) -> DataFrame:
    """Typed records of a text given by hand: an array's items, lines, or one document."""
    if detect_format("pasted", text) == "jsonl":
        lines = [x for x in text.splitlines() if x.strip()]
    else:
        value = parse_json(text)
        lines = [dump_json(x) for x in (value if isinstance(value, list) else [value])]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i bigint, line string")
    array = F.lit("[" + ",".join(lines) + "]")
    kind = spark.range(1).select(F.schema_of_json(array, {"prefersDecimal": "true"})).first()[0].removeprefix("ARRAY<").removesuffix(">")
    return rows.select(F.from_json("line", kind).alias("v"), F.col("i").alias(INDEX)).select("v.*", INDEX)

