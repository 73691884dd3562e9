"""Recipes: versioned, serialisable lists of steps, and their edit history."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from docloom.errors import RecipeError

VERSION = 1


@dataclass(frozen=True)
class Step:
    id: str
    type: str
    config: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    execution: dict[str, Any] | None = None  # a hint that Catalyst doesn't need

    def to_dict(self) -> dict[str, Any]:
        out = {"id": self.id, "type": self.type, "enabled": self.enabled, "config": self.config}
        return out if self.execution is None else out | {"execution": self.execution}


@dataclass(frozen=True)
class Recipe:
    steps: tuple[Step, ...] = ()

    def to_json(self, pretty: bool = True) -> str:
        doc = {"version": VERSION, "steps": [s.to_dict() for s in self.steps]}
        return json.dumps(doc, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))

    @classmethod
    def of(cls, *steps: tuple[str, dict[str, Any]]) -> Recipe:
        """A recipe of (type, config) pairs, with ids made up."""
        return cls(tuple(Step(f"{kind}-{i}", kind, config) for i, (kind, config) in enumerate(steps, 1)))

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        try:
            doc = json.loads(text.removeprefix("﻿"))
        except ValueError as e:
            raise RecipeError(f"a recipe is JSON text, which this isn't: {e}") from e
        if not isinstance(doc, dict):
            raise RecipeError("a recipe is an object with version and steps")
        if isinstance(doc.get("version"), bool) or doc.get("version") not in (VERSION, str(VERSION)) or not isinstance(doc.get("steps"), list):
            raise RecipeError(f"version {VERSION} and a list of steps are needed, got version {doc.get('version')!r}")
        steps = []
        for i, s in enumerate(doc["steps"]):
            if not isinstance(s, dict):
                raise RecipeError(f"step {i}: not an object but {type(s).__name__}")
            if not (isinstance(s.get("id"), str) and isinstance(s.get("type"), str) and isinstance(s.get("enabled"), bool) and isinstance(s.get("config"), dict)):
                raise RecipeError(f"step {i}: needs texts id and type, a boolean enabled and an object config")
            hint = s.get("execution")
            if "execution" in s and not (isinstance(hint, dict) and isinstance(hint.get("kind"), str)):
                raise RecipeError(f"step {i}: execution needs a text kind")
            steps.append(Step(s["id"], s["type"], s["config"], s["enabled"], hint))
        return cls(tuple(steps))


@dataclass(frozen=True)
class History:
    """Past and future recipes around the present one. Every edit returns a new history."""

    present: Recipe = Recipe()
    past: tuple[Recipe, ...] = ()
    future: tuple[Recipe, ...] = ()

    def update(self, recipe: Recipe) -> History:
        return History(recipe, (*self.past, self.present), ())

    def undo(self) -> History:
        return History(self.past[-1], self.past[:-1], (self.present, *self.future)) if self.past else self

    def redo(self) -> History:
        return History(self.future[0], (*self.past, self.present), self.future[1:]) if self.future else self

    def _edited(self, steps: list[Step]) -> History:
        return self.update(Recipe(tuple(steps)))

    def _at(self, step_id: str) -> int:
        for i, s in enumerate(self.present.steps):
            if s.id == step_id:
                return i
        raise RecipeError(f"No step {step_id}")

    def reorder(self, step_id: str, to: int) -> History:
        steps = list(self.present.steps)
        step = steps.pop(self._at(step_id))
        steps.insert(max(0, min(to, len(steps))), step)
        return self._edited(steps)

    def duplicate(self, step_id: str) -> History:
        """The copy follows its original and is called `-copy`, `-copy-2` and so on."""
        steps, at, taken = list(self.present.steps), self._at(step_id), {s.id for s in self.present.steps}
        name, n = f"{step_id}-copy", 2
        while name in taken:
            name, n = f"{step_id}-copy-{n}", n + 1
        steps.insert(at + 1, replace(steps[at], id=name))
        return self._edited(steps)

    def remove(self, step_id: str) -> History:
        at = self._at(step_id)
        return self._edited([s for i, s in enumerate(self.present.steps) if i != at])

    def set_enabled(self, step_id: str, enabled: bool) -> History:
        at = self._at(step_id)
        return self._edited([replace(s, enabled=enabled) if i == at else s for i, s in enumerate(self.present.steps)])


#: The words that open a clause of a request, and the step that each stands for.
VERBS = {"filter": "filter", "where": "filter", "only": "filter", "pick": "pick", "keep": "pick", "select": "pick", "remove": "remove", "drop": "remove", "without": "remove", "sort": "sort", "order": "sort", "distinct": "distinct", "unique": "distinct"}
#: Words that carry nothing, and those that end a clause.
FILLERS, BREAKS = {"by", "on", "where", "field", "fields", "column", "columns", "the", "records", "rows", "of", "a", "is"}, {"and", "then", ";"}
DESCENDING = {"desc", "descending", "down", "largest", "latest"}


def _value(word: str) -> Any:
    try:
        return json.loads(word.lower() if word.lower() in ("true", "false", "null") else word)
    except ValueError:
        return word.strip("'\"")


def _clause(kind: str, words: list[str]) -> tuple[str, dict[str, Any]] | None:
    """One step of a verb's words; None if they say too little."""
    if kind == "filter":
        if len(words) < 3 or words[1] not in ("=", "==", "equals"):
            return None
        return kind, {"field": words[0], "equals": _value(words[2])}
    if kind in ("pick", "remove"):
        return (kind, {"fields": list(dict.fromkeys(words))}) if words else None
    if not words:
        return None
    if kind == "sort":
        return kind, {"key": words[0], "direction": "desc" if DESCENDING & {w.lower() for w in words[1:]} else "asc"}
    return kind, {"key": words[0]}


def suggest(prompt: str) -> tuple[Recipe, str]:
    """A recipe from a plain request, for the user to confirm, and a note on it. A request is
    read word by word: a verb opens a clause, which lasts to the next verb, and each clause
    is one step, in the order they are written."""
    words = prompt.replace(",", " ").replace(";", " ; ").replace("=", " = ").replace("=  =", "==").split()
    clauses: list[tuple[str, list[str]]] = []
    for word in words:
        low = word.lower()
        if low in VERBS and not (clauses and low in FILLERS and not clauses[-1][1]):
            clauses.append((VERBS[low], []))
        elif clauses and low not in BREAKS and not (low in FILLERS and not clauses[-1][1]):
            clauses[-1][1].append(word)
    found = [_clause(*c) for c in clauses]
    steps = tuple(Step(f"{c[0]}-{i}", *c) for i, c in enumerate((c for c in found if c), 1))
    missed = sum(c is None for c in found)
    note = f"Understood {len(steps)} of {len(found)} clauses." if found else f"Nothing understood; a clause begins with one of: {', '.join(VERBS)}."
    return Recipe(steps), note + (" Check the steps before running them." if steps and not missed else "")
