"""Connected components of an edge list, by alternating large and small stars.

Every round hangs each node's neighbours on the smallest neighbour; a component becomes one
star after about log(diameter) rounds. A round is two aggregations and joins whose result is
written to the shared folder, so a lost executor costs one round. Nothing but a row count
and a checksum goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """(v, m) edges. Small: only from nodes to smaller neighbours; large: both ways."""
    if small:
        out = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        out = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    least = out.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = out.join(least, "a")
    if small:
        pairs = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    else:
        pairs = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pairs.where("a <> b").distinct()


def component_roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`edges` (a, b) to (node, root): the smallest node of its component, for every node
    that has an edge and isn't the root itself. Self-loops and nulls are ignored."""
    edges = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(edges)
    for _ in range(rounds):
        edges = written(_star(_star(edges, small=False), small=True), "edges")
        now = mark(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
