"""Node table, profile, schema, validation, diff, patch, embedded JSON, render."""

import collections
import json

import pytest

from docloom import paths, queries
from docloom.errors import PatchError
from docloom.operators import diff, insight, validation
from docloom.operators.nodes import dump_json, node_table, parse_json
from docloom.render import tree_html
from docloom.sources.readers import read_pasted

DATA = "/root/testdata/sf0.001"


def nodes_of(spark, *texts):
    return node_table(spark.createDataFrame(list(enumerate(texts)), "id bigint, doc string"))


def test_profile(spark):
    nodes = nodes_of(spark, '{"users":[{"id":1,"active":true},null]}')
    assert insight.profile(nodes).first().asDict() == {"documents": 1, "objects": 2, "arrays": 1, "primitives": 3, "max_depth": 2}
    assert {r["type"]: r["n"] for r in insight.primitive_types(nodes).collect()} == {"number": 1, "boolean": 1, "null": 1}
    assert [r["length"] for r in insight.array_lengths(nodes).collect()] == [2]
    stats = {r["field"]: r for r in insight.field_stats(nodes).collect()}
    assert stats["active"]["missing"] == 1 and list(stats["id"]["examples"]) == ["1"]


def test_schema(spark):
    nodes = nodes_of(spark, '{"users":[{"id":1,"name":"a"},{"id":2,"name":"b"}]}', '{"users":[1,"two",null]}')
    schema = insight.json_schema(nodes)
    items = schema["properties"]["users"]["items"]
    assert items["type"] == ["null", "number", "object", "string"]
    assert items["properties"] == {"id": {"type": "number"}, "name": {"type": "string"}}
    assert insight.json_schema(nodes.limit(0)) == {"$schema": insight.SCHEMA_URI}


def test_index_lookup_and_search(spark):
    nodes = nodes_of(spark, '{"users":[{"id":9.0}]}')
    assert insight.lookup(nodes, "/users/0/id").first()["raw"] == "9.0"
    assert insight.lookup(nodes, "/users").first()["type"] == "array"
    assert sorted(r["pointer"] for r in insight.search(nodes, "ID").collect()) == ["", "/users", "/users/0", "/users/0/id"]
    assert insight.search(nodes, "(", regex=True).count() == 0
    assert insight.structure_index(nodes, 2)[1] is True


@pytest.mark.parametrize("text", ['{"n":01}', '{"name":"broken}', "true false", '{"a":1 "b":2}', '{"a":[1,2}', "[1,]", "NaN", ""])
def test_bad_documents_are_reported(spark, text):
    row = nodes_of(spark, text, "[]").orderBy("id").collect()
    assert row[0]["error"] and row[0]["pointer"] is None and row[1]["error"] is None


def test_numbers_stay_as_written():
    text = '{"a":900719925474099312345,"b":-123.4500000000000000001e+8}'
    assert dump_json(parse_json(text)) == text
    assert dump_json(parse_json('{"a":[1.0,{}]}'), pretty=True) == '{\n  "a": [\n    1.0,\n    {}\n  ]\n}'


def test_pointers():
    assert paths.pointer(["a/b", "p~", 0]) == "/a~1b/p~0/0"
    assert paths.pointer_parts("/a~1b/p~0/0") == ["a/b", "p~", "0"]
    assert paths.json_path(["a/b", "plain", 0]) == '$["a/b"].plain[0]'


def test_embedded(spark):
    nodes = nodes_of(spark, json.dumps({"payload": '{"id":1}', "note": "[not json"}))
    assert [(r["pointer"], r["value"]) for r in insight.embedded_nodes(nodes).collect()] == [("/payload", '{"id":1}')]


def test_validation(spark):
    df = read_pasted(spark, '[{"user":{"name":1,"tags":["a","bbb"]},"n":5}]')
    schema = {"type": "object", "properties": {"user": {"type": "object", "required": ["id"], "properties": {"name": {"type": "string"}, "tags": {"type": "array", "maxItems": 1, "items": {"maxLength": 2}}}}, "n": {"enum": [1, 2], "maximum": 4, "minimum": 1}}}
    got = {(r["keyword"], r["pointer"]) for r in validation.validate(df, schema).collect()}
    assert got == {("required", "/user/id"), ("type", "/user/name"), ("maxItems", "/user/tags"), ("maxLength", "/user/tags"), ("enum", "/n"), ("maximum", "/n")}
    assert validation.valid(df, {"required": ["user"]}).count() == 1


@pytest.mark.parametrize(("left", "right"), [({"user": {"id": 1, "tags": ["a", "b"]}, "drop": True}, {"user": {"id": 2, "tags": ["a"]}, "new": [1]}), ([1, 2, 3, 4], [1, 5]), ({"a": 1}, [1]), ([1], [2]), ({"a/b": {"": 1}}, {"a/b": {"": 2, "~": None}}), ([], [[], [{}]])])
def test_patches_reproduce_the_right_side(spark, left, right):
    frames = [spark.createDataFrame([(1, json.dumps(x))], "id bigint, doc string") for x in (left, right)]
    ops = diff.patches(diff.diff_documents(*frames)).first()["patch"]
    assert json.loads(diff.apply_patch(json.dumps(left), ops)) == right


def test_diff_paths(spark):
    frames = [spark.createDataFrame([(1, x)], "id bigint, doc string") for x in ('{"user":{"id":1}}', '{"ok":true,"user":{"id":2}}')]
    got = {(r["op"], r["path"], r["from"], r["value"]) for r in diff.diff_documents(*frames).collect()}
    assert got == {("replace", "/user/id", "1", "2"), ("add", "/ok", None, "true")}


def test_diff_shuffles_documents_only(spark):
    """Documents meet once by id, not node by node; what stands on one side only, or isn't
    JSON there, is added or removed whole; duplicate members and equal texts are no trouble."""
    left = [(1, '{"a":[1,2,3,4],"k":{"x":1}}'), (2, "[1]"), (3, "{"), (4, "{}"), (5, None), (6, '{"a":1,"a":2}'), (7, "{"), (None, "1")]
    right = [(1, '{"k":{"x":1.0},"a":[1],"z":null}'), (3, "[]"), (4, "{}"), (5, "0"), (6, '{"a":2}'), (7, "{"), (8, '"s"')]
    frames = [spark.createDataFrame(x, "id bigint, doc string") for x in (left, right)]
    found = diff.diff_documents(*frames)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = collections.defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: r["seq"]):
        got[r["id"]].append((r["op"], r["path"], r["from"], r["value"]))
    assert dict(got) == {
        1: [("remove", "/a/3", "4", None), ("remove", "/a/2", "3", None), ("remove", "/a/1", "2", None), ("replace", "/k/x", "1", "1.0"), ("add", "/z", None, "null")],
        2: [("remove", "", "[1]", None)],
        3: [("add", "", None, "[]")],
        5: [("add", "", None, "0")],
        8: [("add", "", None, '"s"')],
        None: [("remove", "", "1", None)],
    }


def test_nested_diff_parses_pairs_once(spark):
    """One pass over pairs of documents, and the right rows in it."""
    found = queries.nested_diff(spark, DATA)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    orders = {r["o_orderkey"]: r["o_orderstatus"] for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()}
    want = [(k, "replace", "/customer/a.b", '"done"') for k, status in orders.items() if status == "F"] + [(k, "replace", "/items/0/n", "2") for k in orders if k % 3 == 2]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_equal_leaves_get_no_pointers(monkeypatch):
    """Only what differs, or may hold a difference, has its place written out; numbers and
    strings of the same letters differ."""
    asked = []
    monkeypatch.setattr(diff, "pointer", lambda keys: asked.append(keys) or paths.pointer(keys))
    same = {f"same{i}": parse_json(f'"{i}"') for i in range(1000)}
    left, right = ({**same, "list": [*same.values(), last], "one": one, own: None} for last, one, own in (("x", "1", "l/"), ("y", parse_json("1"), "r~")))
    assert [d[:2] for d in diff.differences(left, right)] == [("remove", "/l~1"), ("replace", "/list/1000"), ("replace", "/one"), ("add", "/r~0")]
    assert len(asked) <= 4


def counted(spark, *texts):
    """(the nodes of documents, how many documents were parsed for them)."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, doc string")
    return node_table(docs.mapInArrow(run, docs.schema)), read


def test_profile_and_events_in_one_pass(spark):
    texts = '{"a":[1,{"a":null}],"b":{}}', "[", None
    nodes, read = counted(spark, *texts)
    both = insight.profile(nodes, events=True).first().asDict()
    assert read.value == len(texts)
    assert both == {**insight.profile(nodes).first().asDict(), "events": 2 * 4 + 2 + 3}
    assert queries.nested_profile(spark, DATA)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_node_columns(spark):
    docs = spark.createDataFrame([(1, '{"a":[1,{"a b":"x\\u00e9"}]}'), (2, "{"), (3, None)], "id bigint, doc string")
    every, some = node_table(docs), node_table(docs, columns=("key", "raw"))
    assert some.columns == ["key", "raw"] and some.collect() == every.select("key", "raw").collect()
    assert [r["gpath"] for r in every.where("error is null").orderBy("seq").collect()] == ["$", "$.a", "$.a[*]", "$.a[*]", '$.a[*]["a b"]']


def test_fields_without_examples(spark):
    nodes, read = counted(spark, '{"a":[1,{"a":null}],"b":{}}', '{"b":"x"}')
    plain, full = insight.top_fields(nodes, examples=0), insight.top_fields(nodes)
    plain.collect()
    assert read.value == 2
    assert plain.drop("examples").collect() == full.drop("examples").collect()
    assert {r["field"]: (r["occurrences"], r["missing"], r["types"]) for r in plain.collect()} == {"a": (2, 2, ["null"]), "b": (2, 2, ["string"])}


def test_apply_patch():
    ops = '[{"op":"replace","path":"/users/0/id","value":1},{"op":"add","path":"/users/-","value":{"id":3}},{"op":"test","path":"/active","value":true},{"op":"copy","from":"/users/1","path":"/backup"},{"op":"move","from":"/active","path":"/on"}]'
    assert json.loads(diff.apply_patch('{"users":[{"id":0},{"id":2}],"active":true}', ops)) == {"users": [{"id": 1}, {"id": 2}, {"id": 3}], "backup": {"id": 2}, "on": True}
    for bad in ('[{"op":"remove","path":"/x"}]', '[{"op":"add","path":"/users/9","value":1}]', '[{"op":"test","path":"/active","value":1}]', '[{"op":"what","path":""}]'):
        with pytest.raises(PatchError):
            diff.apply_patch('{"users":[],"active":true}', bad)


def test_apply_patches_reports_errors(spark):
    df = spark.createDataFrame([("[1]", '[{"op":"replace","path":"/0","value":2}]'), ("[1]", '[{"op":"remove","path":"/5"}]'), (None, None), ("[1]", None)], "doc string, patch string")
    got = [(r["patched"], bool(r["error"])) for r in diff.apply_patches(df).collect()]
    assert got == [("[2]", False), (None, True), (None, False), ("[1]", False)]


def test_render():
    html = tree_html(parse_json('{"name":"Ada <dev>","tags":["a","b"],"score":null,"n":1.0}'), {"/name": "replace"})
    assert "Ada &lt;dev&gt;" in html and "2 items" in html and 'class="diff-replace"' in html and "1.0" in html


def test_paths_of_dotted_keys_stay_apart(spark):
    """A key with a dot is another path than nested keys; three distinct examples are kept."""
    from docloom.operators.insight import infer_schema, json_schema
    from docloom.operators.nodes import node_table

    docs = [(i, '{"a.b":%d,"a":{"b":"%s"},"list":[{"c":1}]}' % (i, "pqrpst"[i])) for i in range(6)]
    nodes = node_table(spark.createDataFrame(docs, "id bigint, doc string"))
    found = {r["gpath"]: r for r in infer_schema(nodes).collect()}
    assert (found['$["a.b"]']["types"], found["$.a.b"]["types"], found["$.list[*].c"]["n"]) == (["number"], ["string"], 6)
    assert found["$.a.b"]["examples"] == ["p", "q", "r"]
    schema = json_schema(nodes)["properties"]
    assert schema["a.b"] == {"type": "number"} and schema["a"]["properties"] == {"b": {"type": "string"}}
    assert schema["list"]["items"]["properties"] == {"c": {"type": "number"}}


def test_names_events_and_top_fields(spark):
    nodes = nodes_of(spark, '{"a":[1,{"a":null}],"b":{}}')
    assert insight.event_count(nodes).first()["events"] == 2 * 4 + 2 + 3
    assert {r["field"]: r["n"] for r in insight.property_counts(nodes).collect()} == {"a": 2, "b": 1}
    assert [r["field"] for r in insight.top_fields(nodes, 1).collect()] == ["a"]
    assert insight.event_count(nodes.limit(0)).first()["events"] == 0


def test_sort_by_shown_text(spark):
    df = spark.createDataFrame([(1, [2]), (10, None), (9, [10]), (None, [])], "n int, xs array<int>")
    assert [r["n"] for r in insight.sort_by_text(df, "n").collect()] == [1, 10, 9, None]
    assert [r["n"] for r in insight.sort_by_text(df, "xs", descending=True).collect()] == [10, None, 1, 9]
