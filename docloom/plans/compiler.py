"""From recipes to DataFrames. Every step is compiled, and so checked, before any runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.errors import OperationError
from docloom.operators.rows import Rows
from docloom.operators.steps import STEPS, Transform
from docloom.plans.recipe import Recipe, Step


def compile_step(step: Step) -> Transform:
    if step.type not in STEPS:
        raise OperationError(f"Unknown step type: {step.type}")
    return STEPS[step.type](step.config)


def compile_recipe(recipe: Recipe) -> list[tuple[Step, Transform]]:
    """The enabled steps. An error names the step it lies in."""
    out = []
    for i, step in enumerate(recipe.steps):
        if step.enabled:
            try:
                out.append((step, compile_step(step)))
            except ValueError as e:
                raise OperationError(f"Step {i} ({step.id}): {e}") from e
    return out


def run_recipe(df: DataFrame, recipe: Recipe | str, order: list[str] | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The records of `df`, in the order of the named columns, after all enabled steps."""
    recipe = Recipe.from_json(recipe) if isinstance(recipe, str) else recipe
    rows = Rows.of(df, order, tables)
    for step, transform in compile_recipe(recipe):
        try:
            rows = transform(rows)
        except ValueError as e:
            raise OperationError(f"Step {step.id}: {e}") from e
    return rows.visible


#: Records that a preview runs on.
PREVIEW = 1000


def run_in_mode(df: DataFrame, recipe: Recipe | str, mode: str = "preview", order: list[str] | None = None, tables: dict[str, DataFrame] | None = None, most: int = PREVIEW) -> DataFrame:
    """preview and live run on the first `most` records, full on all."""
    if mode not in ("preview", "live", "full"):
        raise OperationError(f"mode is preview, live or full, not {mode!r}")
    if mode != "full":
        rows = Rows.of(df, order)
        df = rows.df.orderBy(*rows.by()).limit(most)
    return run_recipe(df, recipe, order, tables)


@dataclass(frozen=True)
class StepStats:
    step: str
    status: str
    rows: int | None = None
    bytes: int | None = None


def recipe_stats(df: DataFrame, recipe: Recipe, order: list[str] | None = None, tables: dict[str, DataFrame] | None = None, max_bytes: int | None = None) -> list[StepStats]:
    """Rows and bytes of compact JSON after each step, counted by Spark; disabled steps are
    `skipped`. Beyond `max_bytes` the run fails, as a materialised result of that size would."""
    out, rows = [], Rows.of(df, order, tables)
    for step in recipe.steps:
        if not step.enabled:
            out.append(StepStats(step.id, "skipped"))
            continue
        rows = compile_step(step)(rows)
        size = F.sum(F.octet_length(F.to_json(F.struct(*rows.visible.columns), {"ignoreNullFields": "false"})))
        n, total = rows.visible.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
        if max_bytes is not None and total > max_bytes:
            raise MemoryError(f"Step {step.id}: materialization exceeded {max_bytes} bytes: {total}")
        out.append(StepStats(step.id, "done", n, total))
    return out
