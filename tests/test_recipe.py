import pytest

from docloom.errors import RecipeError
from docloom.plans.codegen import TARGETS, to_sql
from docloom.plans.recipe import History, Recipe, Step, suggest
from docloom.sql import query


def test_round_trip():
    recipe = Recipe((Step("a", "pick", {"fields": ["id"]}), Step("b", "sort", {"key": "id"}, False, {"kind": "streaming"})))
    assert Recipe.from_json(recipe.to_json()) == recipe


@pytest.mark.parametrize("text", ["[]", "{}", '{"version":2,"steps":[]}', '{"version":1,"steps":[1]}', '{"version":1,"steps":[{"id":1,"type":"pick","enabled":true,"config":{}}]}', '{"version":1,"steps":[{"id":"a","type":"pick","enabled":true,"config":{},"execution":{}}]}', "{"])
def test_invalid_documents(text):
    with pytest.raises(RecipeError):
        Recipe.from_json(text)


def test_history():
    h = History().update(Recipe((Step("pick", "pick"), Step("remove", "remove")))).duplicate("pick")
    assert [s.id for s in h.present.steps] == ["pick", "pick-copy", "remove"]
    assert [s.id for s in h.undo().present.steps] == ["pick", "remove"]
    assert h.undo().redo() == h
    assert h.duplicate("pick").present.steps[1].id == "pick-copy-2"
    assert [s.id for s in h.reorder("remove", 0).remove("pick").present.steps] == ["remove", "pick-copy"]
    assert not h.set_enabled("pick", False).present.steps[0].enabled
    with pytest.raises(RecipeError):
        h.remove("none")


def test_suggestions():
    recipe, _ = suggest("filter active = true and sort by createdAt desc")
    assert [(s.type, s.config) for s in recipe.steps] == [("filter", {"field": "active", "equals": True}), ("sort", {"key": "createdAt", "direction": "desc"})]
    assert suggest("keep id, name")[0].steps[0].config == {"fields": ["id", "name"]}
    assert suggest("hello")[0].steps == ()


def test_codegen():
    recipe = Recipe.of(("filter", {"field": "active", "equals": True}))
    assert "select(.active == true)" in TARGETS["jq"](recipe)
    assert "`active` <=> TRUE" in TARGETS["sql"](recipe)
    assert TARGETS["jsonata"](recipe) == "$[active = true]"
    assert "run_recipe" in TARGETS["python"](recipe)


def test_sql_of_replace_and_regex(spark):
    recipe = Recipe.of(("replace", {"field": "a", "from": "x", "to": "it's"}), ("regex", {"field": "b", "pattern": "(\\d)(\\w)", "replacement": "$2$1"}))
    df = spark.createDataFrame([("x", "1a"), (None, "2b")], "a string, b string")
    got = query(df, to_sql(recipe), dialect="spark")
    assert [(r["a"], r["b"]) for r in got.collect()] == [("it's", "a1"), (None, "b2")]
