"""python -m docloom.cli INPUT RECIPE [--output PATH] [--format F] [--max-memory BYTES]"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from docloom.operators.rows import Rows
from docloom.plans.compiler import recipe_stats, run_recipe
from docloom.plans.recipe import Recipe
from docloom.sources.readers import read
from docloom.sources.sinks import FORMATS, export_text, write


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docloom", description="Run a recipe over a source.")
    parser.add_argument("input")
    parser.add_argument("recipe", help="a recipe's JSON file")
    parser.add_argument("--output", help="a folder for part files; else the result is printed")
    parser.add_argument("--format", default="json", choices=FORMATS)
    parser.add_argument("--input-format", choices=FORMATS)
    parser.add_argument("--max-memory", type=int, help="fail if a step's result has more bytes of JSON")
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    began = time.monotonic()
    try:
        recipe = Recipe.from_json(Path(options.recipe).read_text())
        source = read(spark, options.input, options.input_format)
        if options.max_memory is not None:
            recipe_stats(source, recipe, max_bytes=options.max_memory)
        result = run_recipe(source, recipe)
        if options.output:
            write(result, options.format, options.output)
        else:
            print(export_text(result, options.format))
    except (ValueError, MemoryError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print(json.dumps({"steps": sum(s.enabled for s in recipe.steps), "columns": Rows.of(result).fields, "seconds": round(time.monotonic() - began, 3)}), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
