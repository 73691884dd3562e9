"""From documents to packed training sequences: five stages, each written and read again.

A stage takes (spark, docs, sf_dir). All but the last return the columns of `docs`; every
stage works on all that its predecessor kept. Columns of `docs` whose names clash with
those that an operator adds are set aside and come back under their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import near_copies, packing, quality_classifier, secret_scan, source_mix
from docloom.llm.common import scratch, set_aside, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text finds too surprising go."""
    apart, names = set_aside(docs, quality_classifier.ADDED)
    judged = quality_classifier.classify(apart, table(spark, sf_dir, "labels"))
    return judged.where("keep").select(*[F.col(c).alias(names.get(c, c)) for c in apart.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id: texts
    are linked that share 0.8 of their shingles of five words."""
    return near_copies.one_of_each_group(docs, words=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is masked in the text, and n_chars follows."""
    apart, names = set_aside(docs, ("secret_spans",))
    found, _ = secret_scan.scan_secrets(apart)
    return secret_scan.masked(found, count_col="n_chars").select(*[F.col(c).alias(names.get(c, c)) for c in apart.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, left out or shortened, so that sources come to their targets."""
    apart, names = set_aside(docs, ("size", "source_size", "target", "taken"))
    mixed = source_mix.repeat_documents(source_mix.mix_sources(apart))
    return mixed.select(*[F.col(c).alias(names.get(c, c)) for c in apart.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_duplicates), ("secret scans", secrets), ("source mix", mix), ("packing", pack)]

#: Hash functions, language models and tokenizers are beyond SQL; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), lasting=True)
    return docs
