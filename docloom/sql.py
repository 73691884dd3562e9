"""SQL over one source: Spark SQL, with the few forms of DuckDB's dialect that differ."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from docloom.operators.rows import HIDDEN

#: A text, which stays as it is, or a name in double quotes.
QUOTED = re.compile(r"'(?:[^']|'')*'|\"((?:[^\"]|\"\")*)\"")
#: DuckDB's names of functions, with Spark's. Fixed values.
FUNCTIONS = {
    "arg_max": "max_by",
    "arg_min": "min_by",
    "list": "collect_list",
    "list_contains": "array_contains",
    "list_distinct": "array_distinct",
    "list_sort": "array_sort",
    "list_value": "array",
    "list_length": "size",
    "array_length": "size",
    "unnest": "explode",
    "json_extract_string": "get_json_object",
    "json_extract": "get_json_object",
    "regexp_matches": "regexp_like",
    "starts_with": "startswith",
    "ends_with": "endswith",
    "epoch": "unix_timestamp",
    "approx_quantile": "approx_percentile",
}
#: Codes of date formats, with Spark's letters. Fixed values.
DATE_CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%%": "%"}


def date_pattern(codes: str) -> str:
    """A format of codes as Spark's pattern, as a literal of SQL: letters between codes are quoted."""
    pieces = re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", codes)
    return "".join(DATE_CODES.get(p, p) if p[0] == "%" else f"\\'{p}\\'" if p[0].isalpha() else p for p in pieces)


def to_spark(sql: str) -> str:
    """Formats of strftime become patterns. Texts are left alone. Names in double quotes get backticks; `->>` asks for a JSON
    path; EXCLUDE is EXCEPT; read_json_auto('source.json') is the source."""
    sql = re.sub(r"read_json(?:_auto)?\s*\(\s*'[^']*'\s*\)", "source", sql, flags=re.IGNORECASE)
    sql = re.sub(r"([\w.`\"]+)\s*->>?\s*'(\$[^']*)'", r"get_json_object(\1, '\2')", sql)
    sql = re.sub(r"([\w.`\"]+)\s*->>?\s*'([^'$][^']*)'", r"get_json_object(\1, '$.\2')", sql)
    formats: list[str] = []

    def dated(m: re.Match) -> str:
        formats.append(date_pattern(m[2]))
        return f"date_format({m[1]}, __format{len(formats) - 1}__)"

    sql = re.sub(r"\bstrftime\s*\(((?:[^()']|\([^()]*\))*),\s*'([^']*)'\s*\)", dated, sql, flags=re.IGNORECASE)
    out, at = [], 0
    for m in QUOTED.finditer(sql):
        out += [_words(sql[at : m.start()]), m[0].replace("''", "\\'") if m[0][0] == "'" else "`" + m[1].replace('""', '"').replace("`", "``") + "`"]
        at = m.end()
    done = "".join([*out, _words(sql[at:])])
    return re.sub(r"__format(\d+)__", lambda m: f"'{formats[int(m[1])]}'", done)


def _words(text: str) -> str:
    text = re.sub(r"\bEXCLUDE\b", "EXCEPT", text, flags=re.IGNORECASE)
    return re.sub(r"\b([A-Za-z_]\w*)(?=\s*\()", lambda m: FUNCTIONS.get(m[1].lower(), m[1]), text)


def query(df: DataFrame, sql: str, tables: dict[str, DataFrame] | None = None, dialect: str = "duckdb") -> DataFrame:
    """`sql` over `df` as the view `source`, and over other tables by their names. The views
    stand only while the query is read: the session's own of these names come back."""
    session = df.sparkSession
    named = {"source": df, **(tables or {})}
    temporary = {t.name for t in session.catalog.listTables() if t.isTemporary}
    before = {name: session.table(name) for name in named if name.lower() in temporary}
    try:
        for name, table in named.items():
            table.select(*[f"`{c}`" for c in table.columns if not c.startswith(HIDDEN)]).createOrReplaceTempView(name)
        return session.sql(to_spark(sql) if dialect == "duckdb" else sql)
    finally:
        for name in named:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                session.catalog.dropTempView(name)
