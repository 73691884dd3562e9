"""Native steps on small records."""

import json

import pytest

from docloom.errors import OperationError
from docloom.plans.compiler import recipe_stats, run_recipe
from docloom.plans.recipe import Recipe, Step
from docloom.sources.readers import read_pasted

PEOPLE = '[{"id":2,"name":"b","active":true},{"id":1,"name":"a","active":false},{"id":2,"name":"c","active":true}]'


def rows(spark, text, *steps, **kw):
    return [r.asDict(recursive=True) for r in run_recipe(read_pasted(spark, text), Recipe.of(*steps), **kw).collect()]


def test_pick_rename_sort_is_stable(spark):
    got = rows(spark, PEOPLE, ("pick", {"fields": ["id", "name"]}), ("rename", {"from": "name", "to": "label"}), ("sort", {"key": "id"}))
    assert [(r["id"], r["label"]) for r in got] == [(1, "a"), (2, "b"), (2, "c")]
    down = rows(spark, PEOPLE, ("sort", {"key": "id", "direction": "desc"}), ("remove", {"fields": ["active"]}))
    assert [r["name"] for r in down] == ["b", "c", "a"]


def test_distinct_keeps_the_first(spark):
    got = rows(spark, PEOPLE, ("remove", {"fields": ["active"]}), ("distinct", {"key": "id"}), ("sort", {"key": "id", "direction": "desc"}))
    assert got == [{"id": 2, "name": "b"}, {"id": 1, "name": "a"}]
    late = rows(spark, PEOPLE, ("sort", {"key": "name", "direction": "desc"}), ("distinct", {"key": "id"}), ("pick", {"fields": ["name"]}), ("sort", {"key": "name"}))
    assert late == [{"name": "a"}, {"name": "c"}]


def test_records_keep_their_order(spark):
    """Distinct, group and join give records in the input's order, or that of a sort before."""
    df = spark.range(400).repartition(7, "id").selectExpr("id", "id % 11 AS k", "concat('n', id) AS name")
    table = spark.range(11).selectExpr("id AS k", "id * 2 AS twice").repartition(5)
    run = lambda *steps: [r.asDict() for r in run_recipe(df, Recipe.of(*steps), order=["id"], tables={"t": table}).collect()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        down = ("sort", {"key": "id", "direction": "desc"})
        assert [r["id"] for r in run(("distinct", {"key": "k"}))] == list(range(11))
        assert [r["id"] for r in run(down, ("distinct", {"key": "k"}))] == list(range(399, 388, -1))
        assert [r["id"] for r in run(("distinct", {}), ("remove", {"fields": ["name"]}))] == list(range(400))
        assert [r["id"] for r in run(("join", {"leftKey": "k", "rightKey": "k", "right": "t"}))] == list(range(400))
        assert [r["id"] for r in run(down, ("join", {"leftKey": "k", "rightKey": "k", "right": "t"}), ("pick", {"fields": ["id"]}))] == list(range(399, -1, -1))
        grouped = run(down, ("group", {"key": "k"}), ("remove", {"fields": ["group_key"]}))
        assert [r["id"] for r in grouped] == sorted(range(400), key=lambda i: (str(i % 11), -i))
        nested = run(("group", {"key": "k", "shape": "nested"}))
        assert [r["group_key"] for r in nested] == sorted(str(i) for i in range(11))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filter_map_regex_convert(spark):
    got = rows(spark, PEOPLE, ("filter", {"field": "active", "equals": True}), ("map", {"mapping": {"identifier": "id", "label": "name"}}), ("regex", {"field": "label", "pattern": "^", "replacement": "item-"}), ("type-convert", {"field": "identifier", "target": "string"}))
    assert got == [{"identifier": "2", "label": "item-b"}, {"identifier": "2", "label": "item-c"}]


@pytest.mark.parametrize(("config", "n"), [({"field": "id", "equals": 2}, 2), ({"field": "id", "equals": "2"}, 0), ({"field": "gone"}, 3), ({"field": "gone", "equals": None}, 0), ({"field": "id", "exists": True}, 3), ({"field": "gone", "exists": False, "equals": 1}, 3), ({"field": "name", "equals": {"a": 1}}, 0)])
def test_filter_cases(spark, config, n):
    assert len(rows(spark, PEOPLE, ("filter", config))) == n


def test_filter_variant_tells_null_from_missing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, '{"a":null}'), (2, "{}"), (3, '{"a":{"b":[1]}}')], "i int, t string").select("i", F.parse_json("t").alias("v"))
    ids = lambda config: sorted(r["i"] for r in run_recipe(df, Recipe.of(("filter", config))).collect())
    assert ids({"field": "v.a", "exists": True}) == [1, 3]
    assert ids({"field": "v.a", "equals": None}) == [1]
    assert ids({"field": "v.a"}) == [2]
    assert ids({"field": "v.a.b", "equals": [1]}) == [3]


def test_join_last_right_wins_and_null_matches_null(spark):
    text = '[{"id":1},{"id":null},{"id":5}]'
    right = [{"id": 1, "label": "one"}, {"id": 1, "label": "uno"}, {"id": None, "label": "none"}]
    got = rows(spark, text, ("join", {"leftKey": "id", "rightKey": "id", "right": right}), ("sort", {"key": "id", "direction": "desc"}))
    assert [r["joined"] and r["joined"]["label"] for r in got] == [None, "uno", "none"]
    assert rows(spark, text, ("join", {"leftKey": "id", "rightKey": "id", "right": []}))[0]["joined"] is None


def test_lossless_sum_and_numeric_order(spark):
    text = '[{"value":900719925474099312345},{"value":2}]'
    assert str(rows(spark, text, ("aggregate", {"operation": "sum", "field": "value"}))[0]["value"]) == "900719925474099312347"
    assert [str(r["value"]) for r in rows(spark, '[{"value":"10"},{"value":"2"},{"value":"x"},{"value":null}]', ("sort", {"key": "value"}))] == ["None", "2", "10", "x"]


@pytest.mark.parametrize(("operation", "want"), [("count", 2), ("sum", 4), ("avg", 2.0), ("min", 1), ("max", 3)])
def test_aggregates_skip_null(spark, operation, want):
    assert rows(spark, '[{"v":1},{"v":null},{"v":3}]', ("aggregate", {"operation": operation, "field": "v"}))[0]["value"] == want
    assert rows(spark, '[{"v":"a"}]', ("aggregate", {"operation": operation, "field": "v"}))[0]["value"] == (1 if operation == "count" else None)


def test_group_merges_empty_keys(spark):
    text = '[{"k":"a","n":1},{"k":null,"n":2},{"k":"","n":3},{"k":"a","n":4}]'
    got = {r["group_key"]: [x["n"] for x in r["records"]] for r in rows(spark, text, ("group", {"key": "k", "shape": "nested"}))}
    assert got == {"a": [1, 4], "__undefined__": [2, 3]}
    assert sorted((r["group_key"], r["n"]) for r in rows(spark, text, ("group", {"key": "k"}))) == [("__undefined__", 2), ("__undefined__", 3), ("a", 1), ("a", 4)]


def test_flatten_and_unflatten(spark):
    flat = rows(spark, '[{"a":{"b":1,"c":{"d":[1,2]}},"e":2}]', ("flatten", {"separator": "_"}))
    assert flat == [{"a_b": 1, "a_c_d": [1, 2], "e": 2}]
    assert rows(spark, '[{"a_b":1,"a_c":2,"d":3}]', ("unflatten", {"separator": "_"})) == [{"a": {"b": 1, "c": 2}, "d": 3}]


def test_merge_last_value_wins(spark):
    text = '[{"a":1,"b":"x"},{"a":2,"b":null},{"a":null,"b":null}]'
    assert rows(spark, text, ("merge", {})) == [{"a": 2, "b": "x"}]
    assert rows(spark, text, ("sort", {"key": "a", "direction": "desc"}), ("merge", {})) == [{"a": 1, "b": "x"}]


def test_nested_rename_replace_add(spark):
    text = '[{"a":{"b":1,"c":2},"d":"x"}]'
    assert rows(spark, text, ("rename", {"from": "a.b", "to": "z.y"})) == [{"a": {"c": 2}, "d": "x", "z": {"y": 1}}]
    assert rows(spark, text, ("replace", {"field": "a.b", "from": 1, "to": 9})) == [{"a": {"b": 9, "c": 2}, "d": "x"}]
    assert rows(spark, text, ("replace", {"field": "d", "from": "x", "to": None}))[0]["d"] is None
    assert rows(spark, text, ("replace", {"field": "new", "to": 1}))[0]["new"] == 1
    assert rows(spark, text, ("add", {"key": "a.b", "value": [1, {"k": "v"}]}))[0]["a.b"][0] is not None


def test_regex_first_match_groups_and_dollars(spark):
    text = '[{"s":"aXbX"}]'
    one = lambda **c: rows(spark, text, ("regex", {"field": "s", **c}))[0]["s"]
    assert one(pattern="X", replacement="<$&>", flags="") == "a<X>bX"
    assert one(pattern="(a)(X)", replacement="$2$1$$") == "Xa$bX"
    assert one(pattern="x", replacement="-", flags="gi") == "a-b-"
    assert one(pattern="(?<l>[ab])", replacement="$<l>\\", flags="g") == "a\\Xb\\X"


def test_convert(spark):
    one = lambda value, target: rows(spark, json.dumps([{"v": value}]), ("type-convert", {"field": "v", "target": target}))[0]["v"]
    assert one("12.5", "number") == 12.5
    assert one("TRUE", "boolean") is True
    assert one(0, "boolean") is False
    assert one(12, "string") == "12"
    assert one(12, "null") is None
    with pytest.raises(Exception, match="Not a number"):
        one("abc", "number")


def test_validate_fails_on_missing(spark):
    assert len(rows(spark, PEOPLE, ("validate", {"fields": ["id"]}))) == 3
    with pytest.raises(Exception, match="missing required fields: gone, at .*record"):
        rows(spark, PEOPLE, ("validate", {"fields": ["id", "gone"]}))


@pytest.mark.parametrize("step", [("nothing", {}), ("pick", {"fields": "id"}), ("sort", {"key": 1}), ("aggregate", {"operation": "median"}), ("regex", {"field": "a", "pattern": "("}), ("type-convert", {"field": "a", "target": "date"}), ("join", {"leftKey": "a", "rightKey": "b"}), ("filter", {"field": ""})])
def test_bad_configuration_is_refused_at_once(spark, step):
    with pytest.raises(OperationError, match="Step 0"):
        rows(spark, PEOPLE, step)


def test_disabled_steps_and_stats(spark):
    recipe = Recipe((Step("f", "filter", {"field": "active", "equals": True}), Step("off", "pick", {"fields": []}, enabled=False), Step("p", "pick", {"fields": ["id"]})))
    stats = recipe_stats(read_pasted(spark, PEOPLE), recipe)
    assert [(s.status, s.rows) for s in stats] == [("done", 2), ("skipped", None), ("done", 2)]
    with pytest.raises(MemoryError, match="materialization exceeded"):
        recipe_stats(read_pasted(spark, PEOPLE), recipe, max_bytes=1)
