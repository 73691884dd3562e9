"""DuckDB SQL for the same queries."""

from __future__ import annotations

from docloom.queries import SQL

ORACLES = {
    "purchases": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
    "filter_eq": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "filter_number": "SELECT * FROM part WHERE p_size = 15",
    "filter_type_mismatch": "SELECT p_partkey FROM part WHERE false",
    "filter_exists": "SELECT event_id FROM events WHERE props IS NOT NULL",
    "filter_missing": "SELECT event_id FROM events WHERE props IS NULL",
    "filter_exists_some": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "filter_missing_some": "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus = 'F'",
    "generated_edits": r"SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'first' ELSE p_brand END AS p_brand, regexp_replace(p_name, '(\w)(\d+)', '\2-\1', 'g') AS p_name FROM part WHERE p_size IS NOT NULL",
    "preview_mode": "SELECT o_orderkey, o_custkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000) WHERE o_orderstatus = 'F'",
    "json_pages": "SELECT page_id, url AS at, page_id AS id FROM pages WHERE page_id % 3 = 0 AND page_id % 6 <> 0",
    "sorted_by_text": "SELECT p_partkey FROM part ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 100",
    "nested_profile": "SELECT COUNT(*) AS documents, CAST(SUM(2 + (o_orderkey % 3 > 0)::INT) AS BIGINT) AS objects, COUNT(*) AS arrays, CAST(SUM(3 + o_orderkey % 3) AS BIGINT) AS primitives, 2 AS max_depth, CAST(SUM(2 * (3 + (o_orderkey % 3 > 0)::INT) + 3 + o_orderkey % 3 + 5 + (o_orderkey % 3 > 0)::INT) AS BIGINT) AS events FROM orders",
    "nested_schema": """SELECT gpath, types, keys, n FROM (SELECT COUNT(*) AS every, COUNT(*) FILTER (o_orderkey % 3 > 0) AS filled, COUNT(*) FILTER (o_orderkey % 3 = 2) AS two FROM orders), LATERAL (VALUES ('$', 'object', '', every), ('$.id', 'number', 'id', every), ('$.customer', 'object', 'customer', every), ('$.customer.id', 'number', 'id', every), ('$.customer["a.b"]', 'string', 'a.b', every), ('$.items', 'array', 'items', every), ('$.items[*]', 'null,object', '', filled + two), ('$.items[*].n', 'number', 'n', filled)) AS v(gpath, types, keys, n)""",
    "nested_index": "SELECT o_orderkey AS id, '$.items[*].n' AS gpath, 3 AS depth, 'number' AS type, CASE o_orderkey % 3 WHEN 1 THEN '1' ELSE '1.50' END AS raw FROM orders WHERE o_orderkey % 3 > 0",
    "nested_lengths": "SELECT o_orderkey % 3 AS length, COUNT(*) AS n FROM orders GROUP BY 1",
    "nested_depths": "SELECT 0 AS depth, COUNT(*) AS n FROM orders UNION ALL SELECT 1, 2 * COUNT(*) FROM orders UNION ALL SELECT 2, COUNT(*) FROM orders WHERE o_orderkey % 3 > 0",
    "nested_fields": "SELECT field, occurrences, objects - occurrences AS missing, types, false AS inconsistent FROM (SELECT COUNT(*) AS every, COUNT(*) FILTER (o_orderkey % 3 > 0) AS filled, 2 * COUNT(*) + COUNT(*) FILTER (o_orderkey % 3 > 0) AS objects FROM orders), LATERAL (VALUES ('id', 2 * every, 'number'), ('customer', every, ''), ('a.b', every, 'string'), ('items', every, ''), ('n', filled, 'number')) AS v(field, occurrences, types)",
    "nested_names": "SELECT field, n FROM (SELECT COUNT(*) AS every, COUNT(*) FILTER (o_orderkey % 3 > 0) AS filled FROM orders), LATERAL (VALUES ('id', 2 * every), ('customer', every), ('a.b', every), ('items', every), ('n', filled)) AS v(field, n)",
    "nested_diff": """SELECT o_orderkey AS id, 'replace' AS op, '/customer/a.b' AS pointer, '"done"' AS value FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'replace', '/items/0/n', '2' FROM orders WHERE o_orderkey % 3 = 2""",
    "map_fields": "SELECT c_custkey AS id, c_name AS label FROM customer",
    "map_nested": "SELECT c_custkey AS id, c_nationkey AS at_nation, c_mktsegment AS at_segment FROM customer",
    "pick_fields": "SELECT c_name, c_custkey FROM customer",
    "remove_fields": "SELECT p_partkey, p_brand, p_type, p_size FROM part",
    "rename_field": "SELECT n_nationkey, n_regionkey, n_name AS name FROM nation",
    "add_literal": "SELECT n_nationkey, 'x' AS n_name, n_regionkey, true AS checked FROM nation",
    "replace_value": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "regex_replace": r"SELECT p_partkey, regexp_replace(p_name, '([a-z])([a-z])', '\2\1', 'g') AS p_name FROM part",
    "regex_first": r"SELECT c_custkey, regexp_replace(c_name, '(0+)', '<\1>') AS c_name FROM customer",
    "convert_string": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders",
    "convert_number": r"SELECT c_custkey, CAST(regexp_replace(c_name, '\D', '', 'g') AS DOUBLE) AS c_name FROM customer",
    "convert_bool": "SELECT p_partkey, p_size <> 0 AS p_size FROM part",
    "extract_path": "SELECT n_name AS name FROM nation",
    "sort_records": "SELECT s_suppkey, s_acctbal FROM supplier",
    "distinct_key_first": "SELECT user_id, MIN(event_id) AS event_id FROM events GROUP BY user_id",
    "distinct_sorted_first": "SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_type DESC, event_id) AS k FROM events) WHERE k = 1",
    "distinct_record": "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem",
    "group_records": "SELECT COALESCE(NULLIF(o_orderstatus, ''), '__undefined__') AS group_key, o_orderkey FROM orders",
    "flatten_records": 'SELECT n_nationkey AS nation_id, n_name AS nation_name, n_regionkey AS region FROM nation',
    "unflatten_records": "SELECT n_name AS name FROM nation",
    "merge_last_wins": "SELECT arg_max(c_custkey, c_custkey) AS c_custkey, arg_max(c_name, c_custkey) AS c_name, arg_max(c_nationkey, c_custkey) AS c_nationkey, arg_max(c_acctbal, c_custkey) AS c_acctbal, arg_max(c_mktsegment, c_custkey) AS c_mktsegment FROM customer",
    "agg_count": "SELECT COUNT(l_quantity) AS value FROM lineitem",
    "agg_sum": "SELECT CAST(SUM(l_orderkey) AS DECIMAL(38,0)) AS value FROM lineitem",
    "agg_avg": "SELECT CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_quantity) AS value FROM lineitem",
    "agg_min": "SELECT CAST(MIN(l_partkey) AS DECIMAL(38,0)) AS value FROM lineitem",
    "agg_max": "SELECT CAST(MAX(l_partkey) AS DECIMAL(38,0)) AS value FROM lineitem",
    "validate_required": "SELECT o_orderkey FROM orders",
    "jq_select": "SELECT o_orderkey AS value FROM orders WHERE o_orderstatus <> 'F'",
    "jq_map_path": "SELECT c_name AS value FROM customer",
    "jsonata_project": "SELECT o_orderkey AS \"order\", o_orderstatus || '-' || o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "jsonata_count": "SELECT COUNT(*) AS value FROM orders",
    "lookup_join": 'SELECT l_orderkey AS "order", l_linenumber AS line, p_brand AS brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey',
    "inline_join": "SELECT n_nationkey AS nation, CASE n_regionkey WHEN 1 THEN 'uno' WHEN 2 THEN 'two' END AS label FROM nation",
    "group_nested": "SELECT CAST(n_regionkey AS VARCHAR) AS group_key, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    "generated_sql": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
    "required_report": "SELECT 'props' AS field, COUNT(*) - COUNT(props) AS missing FROM events UNION ALL SELECT 'user_id', COUNT(*) - COUNT(user_id) FROM events UNION ALL SELECT 'nothing', COUNT(*) FROM events",
    "profile": "SELECT COUNT(props) AS documents, COUNT(props) AS objects, 0 AS arrays, COUNT(json_extract(props, '$.k')) AS primitives, 0 AS max_depth FROM events",
    "profile_fields": "SELECT 'k' AS field, COUNT(json_extract(props, '$.k')) AS occurrences, COUNT(props) - COUNT(json_extract(props, '$.k')) AS missing, 'number' AS types, (SELECT string_agg(json_extract_string(props, '$.k'), ',' ORDER BY event_id) FROM (SELECT * FROM events WHERE json_extract(props, '$.k') IS NOT NULL ORDER BY event_id LIMIT 3)) AS examples FROM events",
    "schema_types": "SELECT '$' AS gpath, 'object' AS types, COUNT(props) AS n FROM events UNION ALL SELECT '$.k', 'number', COUNT(json_extract(props, '$.k')) FROM events",
    "index_lookup": "SELECT event_id AS id, 'number' AS type, json_extract_string(props, '$.k') AS raw FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "node_search": "SELECT event_id AS id, p AS pointer FROM events CROSS JOIN (SELECT '' AS p UNION ALL SELECT '/k') WHERE starts_with(json_extract_string(props, '$.k'), '7')",
    "embedded_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_type(props) IN ('OBJECT', 'ARRAY')",
    "schema_validate": "SELECT event_id, 'required' AS keyword, '/nothing' AS pointer FROM events UNION ALL SELECT event_id, 'enum', '/event_type' FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_id, 'maxLength', '/event_type' FROM events WHERE length(event_type) > 5 UNION ALL SELECT event_id, 'minimum', '/value' FROM events WHERE value < 10 UNION ALL SELECT event_id, 'maximum', '/value' FROM events WHERE value > 90 UNION ALL SELECT event_id, 'type', '/user_id' FROM events WHERE user_id IS NOT NULL",
    "diff_rows": "SELECT o_orderkey, 'remove' AS op, '' AS pointer, NULL AS value FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT -1 - o_orderkey, 'add', '', NULL FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, 'replace', '/o_orderstatus', 'X' FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0",
    "diff_patch_roundtrip": "SELECT event_id AS id, true AS same FROM events WHERE props IS NOT NULL",
    "table_search": "SELECT c_custkey FROM customer WHERE c_name ILIKE '%build%' OR c_mktsegment ILIKE '%build%'",
    "csv_cells": "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey || ',\"a,\"\"' || n_name || '\"' AS line FROM nation",
    "jsonl_lines": "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS line FROM nation",
    "sql_dialect": "SELECT event_type, MAX(event_id) AS last_id, COUNT(json_extract(props, '$.k')) AS with_k FROM events GROUP BY event_type",
    **SQL,
}
