"""The registered queries of the engine: each operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import sql as sql_entry
from docloom.operators import diff, insight, validation
from docloom.operators.nodes import node_table
from docloom.operators.steps import missing_fields
from docloom.plans.codegen import to_sql
from docloom.plans.compiler import run_in_mode, run_recipe
from docloom.plans.recipe import Recipe
from docloom.sources.pages import page_json
from docloom.sources.sinks import delimited_lines, json_lines

#: Table and key of records in order, and the steps of a recipe.
RECIPES: dict[str, tuple[str, list[str], list[tuple[str, dict]]]] = {
    "purchases": ("events", ["event_id"], [("filter", {"field": "event_type", "equals": "purchase"}), ("sort", {"key": "value", "direction": "desc"}), ("pick", {"fields": ["event_id", "user_id", "value"]})]),
    "filter_eq": ("orders", ["o_orderkey"], [("filter", {"field": "o_orderstatus", "equals": "F"}), ("pick", {"fields": ["o_orderkey", "o_custkey"]})]),
    "filter_number": ("part", ["p_partkey"], [("filter", {"field": "p_size", "equals": 15})]),
    "filter_type_mismatch": ("part", ["p_partkey"], [("filter", {"field": "p_size", "equals": "15"}), ("pick", {"fields": ["p_partkey"]})]),
    "filter_exists": ("events", ["event_id"], [("filter", {"field": "props", "exists": True}), ("pick", {"fields": ["event_id"]})]),
    "filter_missing": ("events", ["event_id"], [("filter", {"field": "props", "exists": False}), ("pick", {"fields": ["event_id"]})]),
    "filter_exists_some": ("orders", ["o_orderkey"], [("replace", {"field": "o_orderstatus", "from": "F", "to": None}), ("filter", {"field": "o_orderstatus", "exists": True}), ("pick", {"fields": ["o_orderkey"]})]),
    "filter_missing_some": ("orders", ["o_orderkey"], [("replace", {"field": "o_orderstatus", "from": "F", "to": None}), ("filter", {"field": "o_orderstatus", "exists": False}), ("pick", {"fields": ["o_orderkey"]})]),
    "map_fields": ("customer", ["c_custkey"], [("map", {"mapping": {"id": "c_custkey", "label": "c_name", "none": "c_nothing"}})]),
    "map_nested": ("customer", ["c_custkey"], [("map", {"mapping": {"id": "c_custkey", "at.nation": "c_nationkey", "at.segment": "c_mktsegment"}}), ("flatten", {"separator": "_"})]),
    "pick_fields": ("customer", ["c_custkey"], [("pick", {"fields": ["c_name", "c_custkey", "c_name", "c_nothing"]})]),
    "remove_fields": ("part", ["p_partkey"], [("remove", {"fields": ["p_name", "p_retailprice", "p_nothing"]})]),
    "rename_field": ("nation", ["n_nationkey"], [("rename", {"from": "n_name", "to": "name"})]),
    "add_literal": ("nation", ["n_nationkey"], [("add", {"key": "checked", "value": True}), ("add", {"key": "n_name", "value": "x"})]),
    "replace_value": ("orders", ["o_orderkey"], [("replace", {"field": "o_orderstatus", "from": "O", "to": "open"}), ("pick", {"fields": ["o_orderkey", "o_orderstatus"]})]),
    "regex_replace": ("part", ["p_partkey"], [("regex", {"field": "p_name", "pattern": "([a-z])([a-z])", "replacement": "$2$1"}), ("pick", {"fields": ["p_partkey", "p_name"]})]),
    "regex_first": ("customer", ["c_custkey"], [("regex", {"field": "c_name", "pattern": "0+", "replacement": "<$&>", "flags": ""}), ("pick", {"fields": ["c_custkey", "c_name"]})]),
    "convert_string": ("orders", ["o_orderkey"], [("type-convert", {"field": "o_custkey", "target": "string"}), ("pick", {"fields": ["o_orderkey", "o_custkey"]})]),
    "convert_number": ("customer", ["c_custkey"], [("regex", {"field": "c_name", "pattern": "\\D", "replacement": ""}), ("filter", {"field": "c_custkey", "exists": True}), ("type-convert", {"field": "c_name", "target": "number"}), ("pick", {"fields": ["c_custkey", "c_name"]})]),
    "convert_bool": ("part", ["p_partkey"], [("type-convert", {"field": "p_size", "target": "boolean"}), ("pick", {"fields": ["p_partkey", "p_size"]})]),
    "extract_path": ("nation", ["n_nationkey"], [("extract", {"path": "n_name", "as": "name"})]),
    "sort_records": ("supplier", ["s_suppkey"], [("sort", {"key": "s_acctbal"}), ("pick", {"fields": ["s_suppkey", "s_acctbal"]})]),
    "distinct_key_first": ("events", ["event_id"], [("distinct", {"key": "user_id"}), ("pick", {"fields": ["user_id", "event_id"]})]),
    "distinct_sorted_first": ("events", ["event_id"], [("sort", {"key": "event_type", "direction": "desc"}), ("distinct", {"key": "user_id"}), ("pick", {"fields": ["user_id", "event_id", "event_type"]})]),
    "distinct_record": ("lineitem", ["l_orderkey", "l_linenumber"], [("pick", {"fields": ["l_returnflag", "l_linestatus", "l_quantity"]}), ("distinct", {})]),
    "group_records": ("orders", ["o_orderkey"], [("group", {"key": "o_orderstatus"}), ("pick", {"fields": ["group_key", "o_orderkey"]})]),
    "flatten_records": ("nation", ["n_nationkey"], [("map", {"mapping": {"nation.id": "n_nationkey", "nation.name": "n_name", "region": "n_regionkey"}}), ("flatten", {"separator": "_"})]),
    "unflatten_records": ("nation", ["n_nationkey"], [("unflatten", {"separator": "_"}), ("extract", {"path": "n.name", "as": "name"})]),
    "merge_last_wins": ("customer", ["c_custkey"], [("merge", {})]),
    "agg_count": ("lineitem", ["l_orderkey", "l_linenumber"], [("aggregate", {"operation": "count", "field": "l_quantity"})]),
    "agg_sum": ("lineitem", ["l_orderkey", "l_linenumber"], [("aggregate", {"operation": "sum", "field": "l_orderkey"})]),
    "agg_avg": ("lineitem", ["l_orderkey", "l_linenumber"], [("aggregate", {"operation": "avg", "field": "l_quantity"})]),
    "agg_min": ("lineitem", ["l_orderkey", "l_linenumber"], [("aggregate", {"operation": "min", "field": "l_partkey"})]),
    "agg_max": ("lineitem", ["l_orderkey", "l_linenumber"], [("aggregate", {"operation": "max", "field": "l_partkey"})]),
    "validate_required": ("orders", ["o_orderkey"], [("validate", {"fields": ["o_orderkey", "o_custkey"]}), ("pick", {"fields": ["o_orderkey"]})]),
    "jq_select": ("orders", ["o_orderkey"], [("jq", {"expression": 'map(select(.o_orderstatus != "F")) | .[].o_orderkey'})]),
    "jq_map_path": ("customer", ["c_custkey"], [("jq", {"expression": "map(.c_name)"})]),
    "jsonata_project": ("orders", ["o_orderkey"], [("jsonata", {"expression": "$[o_orderstatus = 'F' and o_totalprice > 100000].{ 'order': o_orderkey, 'label': o_orderstatus & '-' & o_orderpriority }"})]),
    "jsonata_count": ("orders", ["o_orderkey"], [("jsonata", {"expression": "$count($)"})]),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recipe(name: str):
    table, order, steps = RECIPES[name]
    return lambda spark, sf_dir: run_recipe(_table(spark, sf_dir, table), Recipe.of(*steps), order)


def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as the right side: Catalyst picks the join."""
    steps = Recipe.of(("join", {"leftKey": "l_partkey", "rightKey": "p_partkey", "right": "part", "as": "part"}), ("map", {"mapping": {"order": "l_orderkey", "line": "l_linenumber", "brand": "part.p_brand"}}))
    return run_recipe(_table(spark, sf_dir, "lineitem"), steps, ["l_orderkey", "l_linenumber"], {"part": _table(spark, sf_dir, "part")})


def inline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the recipe as the right side, of which the last of a key wins."""
    right = [{"id": 1, "label": "one"}, {"id": 2, "label": "two"}, {"id": 1, "label": "uno"}]
    steps = Recipe.of(("join", {"leftKey": "n_regionkey", "rightKey": "id", "right": right}), ("map", {"mapping": {"nation": "n_nationkey", "label": "joined.label"}}))
    return run_recipe(_table(spark, sf_dir, "nation"), steps, ["n_nationkey"])


def group_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_recipe(_table(spark, sf_dir, "nation"), Recipe.of(("group", {"key": "n_regionkey", "shape": "nested"})), ["n_nationkey"])
    return df.select("group_key", F.array_join(F.transform("records", lambda r: r["n_name"]), ",").alias("names"))


def generated_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, steps = RECIPES["purchases"]
    return sql_entry.query(_table(spark, sf_dir, "events"), to_sql(Recipe.of(*steps)), dialect="spark")


EDITS = [("filter", {"field": "p_size", "exists": True}), ("replace", {"field": "p_brand", "from": "Brand#1", "to": "first"}), ("regex", {"field": "p_name", "pattern": "(\\w)(\\d+)", "replacement": "$2-$1"}), ("pick", {"fields": ["p_partkey", "p_brand", "p_name"]})]


def generated_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replace and regex as SQL."""
    return sql_entry.query(_table(spark, sf_dir, "part"), to_sql(Recipe.of(*EDITS)), dialect="spark")


def preview_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe on the first thousand records, as a preview shows it."""
    _, order, steps = RECIPES["filter_eq"]
    return run_in_mode(_table(spark, sf_dir, "orders"), Recipe.of(*steps), "preview", order)


def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, of which every third shows its address as JSON and every sixth says more."""
    shown = F.concat(F.lit('<html><body><pre class="j">{&quot;at&quot;: &quot;'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('&quot;, "id": '), "page_id", F.lit("}</pre>"), F.when(F.col("page_id") % 6 == 0, "<p>more</p>").otherwise(""), F.lit("</body></html>"))
    pages = _table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 3 == 0, shown).otherwise(F.col("html")))
    return page_json(pages).select("page_id", F.get_json_object("doc", "$.at").alias("at"), F.get_json_object("doc", "$.id").cast("bigint").alias("id"))


def sorted_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred parts by the text of their keys, as a table shows them."""
    return insight.sort_by_text(_table(spark, sf_dir, "part"), "p_partkey").limit(100).select("p_partkey")


def required_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_fields(_table(spark, sf_dir, "events"), ["props", "user_id", "nothing"])


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("doc"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.profile(node_table(_props(spark, sf_dir)))


def profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = insight.field_stats(node_table(_props(spark, sf_dir)))
    return fields.select("field", "occurrences", "missing", F.array_join("types", ",").alias("types"), F.array_join("examples", ",").alias("examples"))


def schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = insight.infer_schema(node_table(_props(spark, sf_dir)))
    return found.select("gpath", F.array_join("types", ",").alias("types"), "n")


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.lookup(node_table(_props(spark, sf_dir)), "/k").select("id", "type", "raw")


def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.search(node_table(_props(spark, sf_dir)), "^/k k 7", regex=True).select("id", "pointer")


def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = insight.embedded_json(_table(spark, sf_dir, "events"), "props", None)
    return found.select("event_id", F.try_variant_get("value", "$.k", "bigint").alias("k"))


#: Orders as nested documents: arrays of 0 to 2 items, nulls, and keys that need quotes.
NESTED = """concat('{"id":', o_orderkey, ',"customer":{"id":', o_custkey, ',"a.b":"', o_orderstatus, '"},"items":[', CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{"n":1}' ELSE '{"n":1.50},null' END, ']}')"""


def _nested(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return node_table(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(NESTED).alias("doc")), columns=columns or None)


def nested_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.profile(_nested(spark, sf_dir, "parent", "kind", "depth", "key", "error"), events=True)


def nested_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = insight.infer_schema(_nested(spark, sf_dir))
    return found.select("gpath", F.array_join("types", ",").alias("types"), "n", F.array_join("keys", ",").alias("keys"))


def nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.lookup(_nested(spark, sf_dir), "/items/0/n").select("id", "gpath", "depth", "type", "raw")


def nested_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.array_lengths(_nested(spark, sf_dir))


def nested_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.depth_counts(_nested(spark, sf_dir))


def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty fields that occur most often."""
    return insight.top_fields(_nested(spark, sf_dir, "key", "kind", "type"), examples=0).select("field", "occurrences", "missing", F.array_join("types", ",").alias("types"), "inconsistent")


def nested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.property_counts(_nested(spark, sf_dir))


def nested_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents against copies whose status and first item changed."""
    left = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(NESTED).alias("doc"))
    right = left.select("id", F.regexp_replace(F.regexp_replace("doc", '"a\\.b":"F"', '"a.b":"done"'), r"1\.50", "2").alias("doc"))
    return diff.diff_documents(left, right).select("id", "op", F.col("path").alias("pointer"), "value")


SCHEMA = {
    "type": "object",
    "required": ["event_id", "nothing"],
    "properties": {"event_type": {"type": "string", "enum": ["click", "view"], "maxLength": 5}, "value": {"type": "number", "minimum": 10, "maximum": 90}, "user_id": {"type": "string"}},
}


def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(_table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id"), SCHEMA).select("event_id", "keyword", "pointer")


def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy with changed, removed and added rows."""
    left = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    right = left.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.expr("if(o_orderkey % 5 = 0, 'X', o_orderstatus)"))
    right = right.unionByName(left.where("o_orderkey % 11 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    return diff.diff_rows(left, right, ["o_orderkey"]).select("o_orderkey", "op", "pointer", F.when(F.col("op") == "replace", F.col("value")).alias("value"))


def diff_patch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches between documents and edited copies, applied: none may be left different."""
    left = _props(spark, sf_dir).where("doc is not null").select("id", F.concat(F.lit('{"e":'), "doc", F.lit(',"tags":[1,2.50,"x"]}')).alias("doc"))
    right = left.select("id", F.regexp_replace("doc", r'2\.50,"x"', "3").alias("doc"))
    ops = diff.patches(diff.diff_documents(left, right)).withColumnRenamed("id", "pid")
    done = diff.apply_patches(left.join(ops, left["id"] == ops["pid"], "left").select("id", "doc", "patch"))
    return done.withColumnRenamed("id", "rid").join(right.withColumnRenamed("doc", "want"), F.col("rid") == F.col("id")).select("id", F.to_json(F.parse_json("patched")).eqNullSafe(F.to_json(F.parse_json("want"))).alias("same"))


def table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.search_records(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "BUILD").select("c_custkey")


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited_lines(_table(spark, sf_dir, "nation").withColumn("note", F.concat(F.lit('a,"'), "n_name")))


def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_lines(_table(spark, sf_dir, "nation"))


#: SQL that both engines take as it is, over the whole tables.
SQL: dict[str, str] = {
    "sql_group_status": "SELECT o_orderstatus AS status, COUNT(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue FROM orders GROUP BY o_orderstatus ORDER BY orders DESC",
    "sql_inner_join": "SELECT n.n_name AS nation, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "sql_left_join": "SELECT c.c_custkey AS customer, COUNT(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "sql_full_join": "SELECT s.s_nationkey AS sn, c.c_nationkey AS cn, COUNT(*) AS n FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey AND s.s_nationkey < c.c_nationkey GROUP BY s.s_nationkey, c.c_nationkey",
    "sql_semi": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "sql_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "sql_range_join": "SELECT b.lo AS lo, COUNT(*) AS n FROM part p JOIN (SELECT 0 AS lo, 10 AS hi UNION ALL SELECT 10, 30 UNION ALL SELECT 30, 51) b ON p.p_size >= b.lo AND p.p_size < b.hi GROUP BY b.lo",
    "sql_window": "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_it FROM events",
    "sql_frame": "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM events",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_count_distinct": "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "sql_union": "SELECT n_name AS name FROM nation UNION SELECT r_name AS name FROM region",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "sql_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 10",
    "sql_cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT o_orderstatus, COUNT(*) AS n FROM big GROUP BY o_orderstatus",
    "sql_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t",
    "sql_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_strings": "SELECT c_custkey, UPPER(SUBSTRING(c_name, 1, 4)) AS head, LENGTH(c_name) AS n, CONCAT(c_mktsegment, '-', c_name) AS label FROM customer WHERE c_mktsegment LIKE 'B%' OR c_mktsegment IN ('MACHINERY')",
    "sql_dates": "SELECT YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate), MONTH(o_orderdate)",
    "sql_anti_some": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "sql_except_some": "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 30",
    "sql_strftime": "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders",
    "sql_len": "SELECT c_custkey, len(c_name) AS n FROM customer",
    "sql_lists": "SELECT o_orderkey, list_contains(list_value('F', 'O'), o_orderstatus) AS known FROM orders",
    "sql_unnest": "SELECT n_nationkey, unnest(list_value(n_regionkey, n_nationkey)) AS x FROM nation",
    "sql_right_join": "SELECT o.o_orderkey AS k, c.c_custkey AS c FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'",
    "sql_asof": "SELECT event_id, last_purchase FROM (SELECT event_id, MAX(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS last_purchase FROM events) AS e WHERE last_purchase IS NOT NULL",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _sql(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: _table(spark, sf_dir, t) for t in TABLES if f" {t}" in SQL[name]}
        return sql_entry.query(spark.range(1), SQL[name], tables)

    return run


def sql_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DuckDB's forms over the source view."""
    return sql_entry.query(_table(spark, sf_dir, "events"), "SELECT \"event_type\", arg_max(event_id, event_id) AS last_id, COUNT(props->>'$.k') AS with_k FROM read_json_auto('source.json') GROUP BY \"event_type\"")


QUERIES = {
    **{name: _recipe(name) for name in RECIPES},
    **{f.__name__: f for f in (lookup_join, inline_join, group_nested, generated_sql, generated_edits, preview_mode, json_pages, sorted_by_text, required_report, nested_profile, nested_schema, nested_index, nested_lengths, nested_depths, nested_fields, nested_names, nested_diff, profile, profile_fields, schema_types, index_lookup, node_search, embedded_json, schema_validate, diff_rows, diff_patch_roundtrip, table_search, csv_cells, jsonl_lines, sql_dialect)},
    **{name: _sql(name) for name in SQL},
}
