"""Sources, sinks, expressions, SQL, streams, CLI."""

import json
import threading
import time

import pytest

from docloom import cli, queries, sql
from docloom.errors import ExpressionError, OperationError
from docloom.operators.rows import INDEX
from docloom.plans.compiler import run_in_mode, run_recipe
from docloom.plans.jobs import Watched, counted
from docloom.plans.recipe import Recipe
from docloom.sources import readers, sinks
from docloom.sources.pages import page_json
from docloom.sources.readers import preview, read
from docloom.sources.samples import sample_orders
from docloom.streaming import run as streams


@pytest.mark.parametrize(("name", "text", "want"), [("a.jsonl", "x", "jsonl"), ("a.ndjson", "x", "jsonl"), ("a", '{"a":1}\n{"a":2}', "jsonl"), ("a", '{"a":1}\nnot-json', "json"), ("a.json", "1\n2\n3", "json"), ("a.jsonl", "  ", "json"), ("a", "{\n}", "json")])
def test_detection(name, text, want):
    assert readers.detect_format(name, text) == want


def test_json_lines_keep_order_over_files(spark, tmp_path):
    for name, ids in (("a", range(50)), ("b", range(50, 60))):
        (tmp_path / f"{name}.jsonl").write_text("\n" + "\r\n\n".join(json.dumps({"id": i, "k": i % 3}) for i in ids))
    df = readers.read(spark, str(tmp_path), "jsonl")
    assert sorted(r["id"] for r in run_recipe(df, Recipe.of(("distinct", {"key": "k"}))).collect()) == [0, 1, 2]
    assert [r["id"] for r in df.orderBy(INDEX).collect()] == list(range(60))
    assert readers.count_records(spark, str(tmp_path)) == 60


def test_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1}\n{"id":oops}\n')
    assert [r["text"] for r in readers.bad_records(spark, str(tmp_path)).collect()] == ['{"id":oops}']
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read(spark, str(tmp_path), "jsonl", schema="id bigint").collect()


def test_places_of_bad_lines(spark, tmp_path):
    lines = [f'{{"id":{i},"t":"{"é" * (i % 7)}"}}' for i in range(400)]
    for i in (0, 123, 124, 399):
        lines[i] = f"bad {i} é"
    lines[50] = "  "
    text = "\r\n".join(lines[:200]) + "\r\n" + "\n".join(lines[200:])
    (tmp_path / "a.jsonl").write_bytes(text.encode())
    want = [(i - (i > 50), text.encode().index(f"bad {i} ".encode()), f"bad {i} é") for i in (0, 123, 124, 399)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for block in (size, "1000"):  # in one block and in many
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            got = readers.bad_records(spark, str(tmp_path)).orderBy("offset").collect()
            assert [(r["record"], r["offset"], r["text"]) for r in got] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_exact_texts_and_variant(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"n":1.50,"m":900719925474099312345}\n')
    assert readers.read(spark, str(path), exact=True).first()["n"] == "1.50"
    assert str(readers.read(spark, str(path)).first()["m"]) == "900719925474099312345"
    assert readers.read_texts(spark, str(path)).first()["doc"] == '{"n":1.50,"m":900719925474099312345}'
    assert readers.read_variant(spark, str(path)).selectExpr("try_variant_get(value, '$.n', 'double') AS n").first()["n"] == 1.5


def test_exports(spark):
    df = readers.read_pasted(spark, '[{"name":"A, B","count":2,"x":null}]')
    assert sinks.export_text(df, "csv") == 'count,name,x\n2,"A, B",\n'
    assert sinks.export_text(df, "tsv") == "count\tname\tx\n2\tA, B\t\n"
    assert sinks.export_text(df, "jsonl") == '{"count":2,"name":"A, B","x":null}\n'
    assert json.loads(sinks.export_text(df, "json")) == [{"count": 2, "name": "A, B", "x": None}]
    with pytest.raises(ValueError):
        sinks.export_text(df, "xml")


@pytest.mark.parametrize("fmt", ["json", "jsonl", "csv", "tsv", "parquet"])
def test_files_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a,"b'), (2, "c\td")], "id bigint, s string")
    sinks.write(df, fmt, str(tmp_path / "out"))
    back = readers.read(spark, str(tmp_path / "out"), fmt)
    assert sorted((int(r["id"]), r["s"]) for r in back.collect()) == [(1, 'a,"b'), (2, "c\td")]


USERS = '[{"users":[{"name":"Ada","active":true},{"name":"Lin","active":false}]}]'


def test_jq(spark):
    run = lambda text, x: [r.asDict(recursive=True) for r in run_recipe(readers.read_pasted(spark, text), Recipe.of(("jq", {"expression": x}))).collect()]
    assert run(USERS, ".users | map(.name)") == [{"value": ["Ada", "Lin"]}]
    assert run(USERS, ".users | map(select(.active == true)) | map(.name)") == [{"value": ["Ada"]}]
    assert run(USERS, ".users | .[] | .name") == [{"value": "Ada"}, {"value": "Lin"}]
    people = '[{"name":"a|b","n":1},{"name":"c","n":2}]'
    assert run(people, 'map(select(.name == "a|b")) | .[].n') == [{"value": 1}]
    assert run(people, ".") == [{"n": 1, "name": "a|b"}, {"n": 2, "name": "c"}]
    for bad in (".missing", "map(.name", "sort_by(.n)", "map(select(.n > 1))"):
        with pytest.raises(ValueError):
            run(people, bad)


def test_jsonata(spark):
    run = lambda x: [r.asDict() for r in run_recipe(readers.read_pasted(spark, '[{"id":1,"name":"a","on":true},{"id":2,"name":"b\'c","on":false}]'), Recipe.of(("jsonata", {"expression": x}))).collect()]
    assert run("$[on].{ 'id': id, 'label': name }") == [{"id": 1, "label": "a"}]
    assert run("$[name = \"b'c\" or id > 5].{ 'x': $uppercase(name) & '!' }") == [{"x": "B'C!"}]
    assert run("$sort($, function($a, $b) { $a.id < $b.id }).id") == [{"value": 2}, {"value": 1}]
    assert run("$sum($.id)") == [{"value": 3}]
    assert run("$count($)") == [{"value": 2}]
    for bad in ("$[", "$map($, f)", "$.{ id }", "$[$evil(id)]"):
        with pytest.raises((ExpressionError, ValueError)):
            run(bad)


def test_sql(spark):
    df = readers.read_pasted(spark, '[{"a b":1,"k":"x"},{"a b":2,"k":"it\'s"}]')
    got = sql.query(df, "SELECT k, \"a b\" AS n, 'say \"hi\"' AS t FROM read_json_auto('source.json') WHERE k = 'it''s'").collect()
    assert [tuple(r) for r in got] == [("it's", 2, 'say "hi"')]
    assert sql.query(df, 'SELECT * EXCLUDE (k) FROM source').columns == ["a b"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":1,"k":"a","v":2}\n{"id":2,"k":"a","v":3}\n{"id":3,"k":"b","v":4}\n')
    source = lambda: streams.read_stream(spark, str(tmp_path / "in"), "id bigint, k string, v bigint", files_per_trigger=1)

    def result(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.table(name).collect())

    recipe = Recipe.of(("filter", {"field": "v", "exists": True}), ("distinct", {"key": "k"}), ("pick", {"fields": ["k"]}))
    assert result(streams.stream_recipe(source(), recipe), "s1") == [("a",), ("b",)]
    assert [int(r[0]) for r in result(streams.stream_recipe(source(), Recipe.of(("aggregate", {"operation": "sum", "field": "v"}))), "s2", "complete")] == [9]
    with pytest.raises(ValueError, match="start_batches"):
        streams.stream_recipe(source(), Recipe.of(("sort", {"key": "v"})))
    got = []
    streams.start_batches(source(), Recipe.of(("sort", {"key": "v", "direction": "desc"})), lambda df, n: got.extend(r["id"] for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    assert got == [3, 2, 1]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in.jsonl").write_text('{"id":1,"state":"new"}\n{"id":2,"state":"old"}\n')
    (tmp_path / "r.json").write_text(Recipe.of(("add", {"key": "reviewed", "value": True})).to_json())
    assert cli.main([str(tmp_path / "in.jsonl"), str(tmp_path / "r.json"), "--format", "jsonl"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == '{"id":1,"state":"new","reviewed":true}'
    assert cli.main([str(tmp_path / "in.jsonl"), str(tmp_path / "r.json"), "--max-memory", "1"]) == 1
    assert "materialization exceeded" in capsys.readouterr().err


def test_every_query_has_an_oracle_and_runs(spark):
    from conftest import DATA

    import __spark_entry__ as entry
    from docloom.oracles import ORACLES

    assert set(ORACLES) == set(queries.QUERIES)
    assert entry.entry(spark).columns == ["event_id", "user_id", "value"]
    for name in ("lookup_join", "profile", "diff_rows", "sql_window"):
        assert queries.QUERIES[name](spark, DATA).columns


def test_full_join_keeps_every_row(spark):
    """All suppliers and all customers are counted, those without a partner too."""
    from conftest import DATA

    got = queries.QUERIES["sql_full_join"](spark, DATA).collect()
    suppliers, customers = (spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("supplier", "customer"))
    assert sum(r["n"] for r in got if r["sn"] is not None) == suppliers
    assert sum(r["n"] for r in got if r["cn"] is not None) == customers
    assert any(r["sn"] is None for r in got) and any(r["cn"] is None for r in got)


def test_sql_forms_and_views(spark):
    from docloom.sql import query

    df = spark.sql("SELECT 1 AS id, 'abc' AS name, timestamp'2024-03-05 06:07:08' AS at")
    spark.sql("SELECT 'mine' AS x").createOrReplaceTempView("source")
    row = query(df, "SELECT len(name) AS n, strftime(at, '%Y-%m') AS month, strftime(at, '%dT%H:%M') AS t FROM source").first()
    assert tuple(row) == (3, "2024-03", "05T06:07")
    assert spark.table("source").columns == ["x"]
    spark.catalog.dropTempView("source")


def test_json_of_pages(spark):
    pre = "<html><head></head><BODY class='x'>\n<pre style='a'>{pre}</pre>\n</BODY></html>"
    cases = [(1, pre.replace("{pre}", '{&quot;a&quot;:&quot;&lt;&amp;lt;&quot;}'), None), (2, pre.replace("{pre}", "not json"), None), (3, "<html><body><pre>[1]</pre><p>x</p></body></html>", "text/html"), (4, "[1, 2]", "application/json; charset=utf-8"), (5, "{}", "application/ld+json"), (6, None, None), (7, "", ""), (8, "<html><body>text<pre>[1]</pre></body></html>", None), (9, pre.replace("{pre}", "<b>[1]</b>"), None), (10, "[1]", "text/json+html-not")]
    pages = spark.createDataFrame(cases, "id int, html string, kind string")
    assert {r["id"]: r["doc"] for r in page_json(pages, "html", "kind").collect()} == {1: '{"a":"<&lt;"}', 4: "[1, 2]", 5: "{}"}
    assert [r["id"] for r in page_json(pages).collect()] == [1]
    assert page_json(pages.limit(0)).count() == 0


def test_sample_orders_agree_on_every_run(spark):
    orders = sample_orders(spark, 80)
    rows = orders.orderBy("createdAt").collect()
    assert len(rows) == 80 and rows == sample_orders(spark, 80).orderBy("createdAt").collect()
    assert all(r["total"] == sum(x["price"] * x["quantity"] for x in r["items"]) for r in rows)
    assert len({r["status"] for r in rows}) > 1 and {len(r["items"]) for r in rows} <= {1, 2, 3, 4}
    assert sample_orders(spark, 200).where("id = 'order-7'").first() == rows[6]


def test_preview_and_modes(spark, tmp_path):
    path = str(tmp_path / "n.jsonl")
    (tmp_path / "n.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(50)))
    shown = preview(spark, path, most=5)
    assert (shown.format, shown.records.count()) == ("jsonl", 5) and shown.text.startswith('{"n":0}')
    recipe = Recipe.of(("sort", {"key": "n", "direction": "desc"}))
    run = lambda mode: [int(r["n"]) for r in run_in_mode(read(spark, path), recipe, mode, most=3).collect()]
    assert run("preview") == run("live") == [2, 1, 0] and run("full") == list(range(49, -1, -1))
    with pytest.raises(OperationError, match="mode"):
        run("fast")


def test_watched_runs(spark):
    with Watched(spark) as run:
        df, count = counted(spark.range(1000, numPartitions=4))
        df.write.format("noop").mode("overwrite").save()
        assert count.get["records"] == 1000
        done = run.progress()
        assert done.total >= 4 and done.done == done.total

    def asleep(batches):
        time.sleep(60)
        yield from batches

    with Watched(spark) as slow:
        timer = threading.Timer(2, slow.cancel)
        timer.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(4, numPartitions=4).mapInArrow(asleep, "id bigint").write.format("noop").mode("overwrite").save()
        timer.join()
    assert spark.range(3).count() == 3
