"""Sinks: JSON, JSON Lines and delimited text, as lines of a DataFrame or as files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.rows import HIDDEN
from docloom.paths import ref
from docloom.semantics import is_nested

FORMATS = ("json", "jsonl", "ndjson", "csv", "tsv", "parquet")


def _visible(df: DataFrame) -> DataFrame:
    return df.select(*[ref(c) for c in df.columns if not c.startswith(HIDDEN)])


def json_lines(df: DataFrame) -> DataFrame:
    """(line): each record as compact JSON, nulls included."""
    df = _visible(df)
    return df.select(F.to_json(F.struct(*[ref(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("line"))


def _cell(col: Column, kind: T.DataType, separator: str) -> Column:
    text = F.to_json(col) if is_nested(kind) else col.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike(f'[{separator}"\\n\\r]'), quoted).otherwise(text), F.lit(""))


def delimited_lines(df: DataFrame, separator: str = ",") -> DataFrame:
    """(line): cells of each record; null is empty, nested values are JSON; quoted only where
    the separator, a quote or a line break is inside."""
    df = _visible(df)
    cells = [_cell(ref(f.name), f.dataType, separator) for f in df.schema]
    return df.select(F.array_join(F.array(*cells), separator).alias("line"))


def header(df: DataFrame, separator: str = ",") -> str:
    names = [c for c in df.columns if not c.startswith(HIDDEN)]
    return separator.join('"' + c.replace('"', '""') + '"' if any(x in c for x in (separator, '"', "\n", "\r")) else c for c in names)


def write(df: DataFrame, fmt: str, path: str, include_header: bool = True) -> None:
    """A folder of part files in the frame's own partitions. json is one array, which takes
    one file: use jsonl for what is large."""
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    df = _visible(df)
    if fmt == "parquet":
        df.write.parquet(path)
    elif fmt in ("jsonl", "ndjson"):
        json_lines(df).write.text(path)
    elif fmt == "json":
        df.coalesce(1).select(F.to_json(F.struct(*[ref(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("line")).mapInPandas(_as_array, "line string").write.text(path)
    else:
        nested = [F.to_json(ref(f.name)).alias(f.name) if is_nested(f.dataType) else ref(f.name) for f in df.schema]
        df.select(*nested).write.option("header", include_header).option("sep", "," if fmt == "csv" else "\t").option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def _as_array(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of one partition as the lines of a JSON array."""
    mark = "["
    for frame in frames:
        lines = []
        for record in frame["line"]:
            lines.append(mark + record)
            mark = ","
        yield pd.DataFrame({"line": lines})
    yield pd.DataFrame({"line": ["[]" if mark == "[" else "]"]})


def export_text(df: DataFrame, fmt: str, most: int = 100_000) -> str:
    """The export of a result small enough for the driver; more than `most` records fail."""
    lines = {"csv": lambda: delimited_lines(df), "tsv": lambda: delimited_lines(df, "\t")}.get(fmt, lambda: json_lines(df))()
    got = [r[0] for r in lines.limit(most + 1).collect()]
    if len(got) > most:
        raise MemoryError(f"More than {most} records: write to files instead")
    if fmt in ("csv", "tsv"):
        return "\n".join([header(df, "," if fmt == "csv" else "\t"), *got]) + "\n"
    if fmt in ("jsonl", "ndjson"):
        return "\n".join(got) + "\n"
    if fmt == "json":
        from docloom.operators.nodes import dump_json, parse_json

        return dump_json([parse_json(x) for x in got], pretty=True)
    raise ValueError(f"Unsupported format: {fmt}")
