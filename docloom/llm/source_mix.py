"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size (words). The mix asks for `share` times all words,
dealt by weight. A source stops at `max_epochs` times its size; what it can't take goes to
the others by weight, until none is above its cap. A document is then taken
floor(target / size of its source) times whole; documents drawn by a seeded hash are taken
once more, and the one document at the boundary is taken in part, so that the words taken
from a source are its target, rounded.

Only DataFrame functions are used. A source with a third of all rows is never gathered:
its draw is found from sums over 4096 hash bins, and only the documents of the one bin at
the boundary are sorted.

Defined cases: null text is empty; a null source is a source of its own, last in order;
documents without words are taken zero times; repeated rows are documents of their own; rows
of one id are drawn in the order of their sizes and texts; columns that are called like those
added (size, source_size, target, taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, n_words, written

BINS = 4096
#: Bits of the hash that orders documents, and of what is left within a bin.
HASH_HEX, BIN_SHIFT = 12, 36


def ranked_sources(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """`sources` (source, source_size) with `weight`, dealt in turn by code point, null last.

    Ranks come from a range partitioning and the partitions' counts: no task sees all sources.
    """
    dealt = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = dealt.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return dealt.join(before.select("part", "before"), "part").select("source", "source_size", pick.alias("weight"))


def water_level(sources: DataFrame, share: float, max_epochs: float) -> float:
    """The level L at which the sum of min(cap, L * weight) is `share` of all sizes."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        free = F.lit(level) * F.col("weight") < cap if level >= 0 else F.lit(True)
        clamped, weight = sources.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight")))).first()
        if not weight:
            return max(level, 0.0)
        now = (share * total - (clamped or 0.0)) / weight
        if now <= level:
            return level
        level = now


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with size, source_size, target and taken (words that the mix takes)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "source_size", "target", "taken") and c not in (id_col, text_col, source_col)])
    u, bin_, key, info = (free_name(docs, c) for c in ("u", "bin", "key", "info"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, HASH_HEX), 16, 10).cast("long")
    sized = docs.withColumn("size", n_words(F.col(text_col))).withColumn(u, draw).withColumn(bin_, F.shiftright(F.col(u), BIN_SHIFT).cast("int"))
    bins = written(sized.groupBy(F.col(source_col).alias("source"), F.col(bin_).alias("bin")).agg(F.sum("size").alias("words")), "mix-bins")
    sources = written(ranked_sources(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights), "mix-weights")
    level = water_level(sources, share, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    target = F.least(F.lit(level) * F.col("weight"), cap)
    sources = sources.withColumn("target", target)
    sources = sources.withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"))
    sources = sources.withColumn("need", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    in_source = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below = bins.withColumn("below", F.coalesce(F.sum("words").over(in_source), F.lit(0))).alias("b")
    edges = below.join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).where((F.col("below") <= F.col("need")) & (F.col("need") < F.col("below") + F.col("words")))
    edges = edges.select(F.col("s.source").alias("source"), F.col("bin").alias("edge"), "below")
    known = sources.alias("s").join(edges.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
    known = written(known.select(F.col("s.source").alias(key), F.struct("source_size", "target", "whole", "need", "edge", "below").alias(info)), "mix-plan")
    joined = sized.join(known, sized[source_col].eqNullSafe(known[key])).drop(key)
    i = lambda c: F.col(f"{info}.{c}")
    at_edge = F.coalesce(F.col(bin_) == i("edge"), F.lit(False))
    clear = joined.where(~at_edge).withColumn("taken", F.col("size") * (i("whole") + F.when(F.col(bin_) < F.coalesce(i("edge"), F.when(i("need") >= i("source_size"), BINS).otherwise(-1)), 1).otherwise(0)))
    order = Window.partitionBy(source_col).orderBy(u, id_col, "size", F.xxhash64(text_col), text_col).rowsBetween(Window.unboundedPreceding, -1)
    left = i("need") - i("below") - F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = joined.where(at_edge).withColumn("taken", F.col("size") * i("whole") + F.least(F.col("size"), F.greatest(left, F.lit(0))))
    out = clear.unionByName(edge)
    return out.withColumn("source_size", i("source_size")).withColumn("target", i("target")).drop(u, bin_, info)


def repeat_documents(mixed: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The rows of the mix: each document as often as it is taken whole, and once more
    with its first words if it is taken in part. `count_col` follows a shortened text."""
    n, part = free_name(mixed, "n"), free_name(mixed, "part")
    whole = F.coalesce(F.floor(F.try_divide(F.col("taken"), F.col("size"))), F.lit(0)).cast("int")
    rest = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = mixed.withColumn(part, F.explode(copies))
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"{WORD}[ \\x09-\\x0D]*"), F.lit(0)), 1, F.greatest(F.col(part), F.lit(1)).cast("int"))
    rows = rows.withColumn(text_col, F.when(F.col(part) > 0, F.concat_ws("", words)).otherwise(F.col(text_col)))
    if count_col in mixed.columns:
        rows = rows.withColumn(count_col, F.when(F.col(part) > 0, F.length(text_col).cast(mixed.schema[count_col].dataType)).otherwise(F.col(count_col)))
    return rows.drop(part, n, "size", "source_size", "target", "taken")
