"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other letter stays as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def n_words(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the cluster names none, only a local
    master may fall back to a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{tempfile.gettempdir()}/docloom-shared"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_folder: ContextVar[str] = ContextVar("folder", default="")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is `written` within goes when it ends; nothing that outlasts it may need it."""
    name = f"scratch-{uuid.uuid4().hex}/"
    before = _folder.set(name)
    try:
        yield
    finally:
        _folder.reset(before)
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def _held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """The shuffle files of what is `written` within go when it is written."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, most: int = 8_000_000):
    """What runs within gets Arrow batches of about `most` bytes, or of one row of more."""
    return _held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def written(df: DataFrame, name: str, lasting: bool = False, by: str | None = None, group: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, and a lost
    executor costs nothing that came before. What is `lasting` outlasts a `scratch`. Rows
    that differ `by` a column lie in folders of their own, so that a filter reads only its.
    Rows of megabytes go to row groups of `group` each: tasks hold one group to write or read
    it, and by default one has a hundred rows at least before its size is looked at."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{'' if lasting else _folder.get()}{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if group:
        writer = writer.option("parquet.block.row.count.limit", str(group))
    writer.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that one task takes in a join; rows that may be broadcast.
HOT_ROWS, SMALL_ROWS = 65_536, 100_000


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", limit: int = HOT_ROWS) -> DataFrame:
    """`many` joined with `one`, which has a row per key, where a key may hold a great part
    of `many`: keys of more than `limit` rows are split, and their row of `one` repeated."""
    hot = many.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    hot = written(hot.select(key, F.ceil(F.col("n") / limit).cast("int").alias("split")), "hot-keys")
    n = hot.count()
    if not n:
        return many.join(one, key, how)
    hot = F.broadcast(hot) if n <= SMALL_ROWS else hot
    others = [c for c in many.columns if c != key]
    split = F.coalesce("split", F.lit(1))
    left = many.join(hot, key, "left").withColumn("split", F.pmod(F.xxhash64(*others) if others else F.lit(0), split).cast("int"))
    right = one.join(hot, key, "left").withColumn("split", F.explode(F.sequence(F.lit(0), split - 1)))
    return left.join(right, [key, "split"], how).drop("split")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns called like one of `names` renamed, and {new name: old name}."""
    old = {}
    for column in [c for c in df.columns if c.lower() in {n.lower() for n in names}]:
        new = free_name(df, f"aside_{column}")
        df, old[new] = df.withColumnRenamed(column, new), column
    return df, old
