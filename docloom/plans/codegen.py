"""Runnable code from recipes: PySpark, Spark SQL, jq and JSONata."""

from __future__ import annotations

import json

from docloom.errors import OperationError
from docloom.functions.regex import java_pattern, java_replacement
from docloom.paths import parts
from docloom.plans.recipe import Recipe, Step


def _name(path: str) -> str:
    return ".".join(f"`{p}`" for p in parts(path))


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql(step: Step, source: str) -> str:
    c = step.config
    if step.type == "filter":
        if "exists" in c:
            return f"SELECT * FROM {source} WHERE {_name(c['field'])} IS {'NOT ' if c['exists'] else ''}NULL"
        return f"SELECT * FROM {source} WHERE {_name(c['field'])} <=> {_sql_literal(c.get('equals'))}"
    if step.type == "pick":
        return f"SELECT {', '.join(f'`{f}`' for f in c['fields'])} FROM {source}"
    if step.type == "remove":
        return f"SELECT * EXCEPT ({', '.join(f'`{f}`' for f in c['fields'])}) FROM {source}"
    if step.type == "rename":
        return f"SELECT * EXCEPT ({_name(c['from'])}), {_name(c['from'])} AS `{c['to']}` FROM {source}"
    if step.type == "add":
        return f"SELECT *, {_sql_literal(c.get('value'))} AS `{c['key']}` FROM {source}"
    if step.type == "replace":
        name = _name(c["field"])
        hit = f"{name} <=> {_sql_literal(c['from'])}" if "from" in c else f"{name} IS NULL"
        return f"SELECT * EXCEPT ({name}), CASE WHEN {hit} THEN {_sql_literal(c.get('to'))} ELSE {name} END AS {name} FROM {source}"
    if step.type == "regex" and c.get("flags", "g") == "g":
        name = _name(c["field"])
        return f"SELECT * EXCEPT ({name}), regexp_replace({name}, {_sql_literal(java_pattern(c['pattern']))}, {_sql_literal(java_replacement(c.get('replacement', '')))}) AS {name} FROM {source}"
    if step.type == "map":
        return f"SELECT {', '.join(f'{_name(s)} AS `{t}`' for t, s in c['mapping'].items())} FROM {source}"
    if step.type == "extract":
        return f"SELECT {_name(c['path'])} AS `{c.get('as', 'value')}` FROM {source}"
    if step.type == "sort":
        down = c.get("direction") == "desc"
        return f"SELECT * FROM {source} ORDER BY {_name(c['key'])} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}"
    if step.type in ("distinct", "deduplicate") and not c.get("key"):
        return f"SELECT DISTINCT * FROM {source}"
    if step.type == "aggregate":
        name = {"count": "COUNT", "sum": "SUM", "avg": "AVG", "min": "MIN", "max": "MAX"}[c["operation"]]
        return f"SELECT {name}({_name(c['field']) if c.get('field') else '*'}) AS value FROM {source}"
    raise OperationError(f"No SQL for step type {step.type}")


def to_sql(recipe: Recipe, table: str = "source") -> str:
    """One common table expression per step; runs as it is with spark.sql."""
    ctes, source = [], table
    for i, step in enumerate([s for s in recipe.steps if s.enabled], 1):
        ctes.append(f"s{i} AS ({_sql(step, source)})")
        source = f"s{i}"
    return (f"WITH {', '.join(ctes)} " if ctes else "") + f"SELECT * FROM {source}"


def to_pyspark(recipe: Recipe) -> str:
    return f"from docloom.plans.compiler import run_recipe\n\nresult = run_recipe(df, {recipe.to_json(pretty=False)!r})\n"


def _key(name: str) -> str:
    return json.dumps(name, ensure_ascii=False)


def _jq(step: Step) -> str:
    c = step.config
    if step.type == "filter" and "exists" not in c:
        return f"map(select(.{c['field']} == {json.dumps(c.get('equals'), ensure_ascii=False)}))"
    if step.type == "pick":
        return "map({" + ", ".join(f"{_key(f)}: .[{_key(f)}]" for f in c["fields"]) + "})"
    if step.type == "remove":
        return "map(del(" + ", ".join(f".[{_key(f)}]" for f in c["fields"]) + "))"
    if step.type == "rename":
        return f"map(.{c['from']} as $v | del(.{c['from']}) | . + {{{_key(c['to'])}: $v}})"
    if step.type == "sort":
        return f"sort_by(.{c['key']})" + (" | reverse" if c.get("direction") == "desc" else "")
    if step.type == "jq":
        return c.get("expression", ".")
    return f"# {step.type} {json.dumps(c, ensure_ascii=False)}"


def _jsonata(step: Step) -> str:
    c = step.config
    if step.type == "jsonata":
        return c["expression"]
    if step.type == "filter" and "exists" not in c:
        return f"$[{c['field']} = {json.dumps(c.get('equals'), ensure_ascii=False)}]"
    if step.type == "sort":
        return f"$sort($, function($a, $b) {{ $a.{c['key']} {'<' if c.get('direction') == 'desc' else '>'} $b.{c['key']} }})"
    return f"/* {step.type}: {json.dumps(c, ensure_ascii=False)} */ $"


def to_jq(recipe: Recipe) -> str:
    return " | ".join(_jq(s) for s in recipe.steps if s.enabled) or "."


def to_jsonata(recipe: Recipe) -> str:
    return "\n".join(_jsonata(s) for s in recipe.steps if s.enabled) or "$"


TARGETS = {"sql": to_sql, "pyspark": to_pyspark, "python": to_pyspark, "jq": to_jq, "jsonata": to_jsonata}
