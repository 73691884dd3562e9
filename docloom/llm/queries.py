"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, maxent_lm, packing, phrase_fingerprint, quality_classifier, secret_scan, simhash, source_mix, suffix_dedup, url_reputation
from .common import table

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_url_filters(spark, sf_dir):
    """A page is labelled where the number in its path is a labelled document: good if its
    quality is 1 and it isn't toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    numbered = pages.select(url_reputation.url_host(F.col("url")).alias("host"), F.expr(r"try_cast(regexp_extract(url, r'://[^/?#]*/[^/?#]*/(\d+)', 1) AS BIGINT)").alias("doc_id"))
    outcomes = numbered.join(labels, "doc_id", "left").select("host", "good")
    return url_reputation.filter_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_secret_scans(spark, sf_dir):
    """As two deliveries: the base rules first, then all rules, of which the ledger of the
    first leaves only the added ones to be run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = secret_scan.scan_secrets(docs, rules=secret_scan.BASE_RULES)
    found, _ = secret_scan.scan_secrets(docs, ledger)
    spans = F.col("secret_spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE_RULES)],
        F.sha2(secret_scan.span_text(spans, only=len(secret_scan.BASE_RULES)), 256).alias("base_sha256"),
        secret_scan.span_text(spans).alias("spans"),
    )


def op3_suffix_dedup(spark, sf_dir):
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_classifier(spark, sf_dir):
    """The documents that pass, with what they were judged by."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality_classifier.classify(docs, labels, columns=["doc_id", "lang"])
    return judged.where("keep").drop("keep")


def op5_ann(spark, sf_dir):
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op6_maxent_lm(spark, sf_dir):
    return maxent_lm.score_corpus(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_packing(spark, sf_dir):
    """With the public word tokenizer; its file's place is asked of its own package."""
    import public_tokenizers

    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op8_simhash(spark, sf_dir):
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_phrase_fingerprints(spark, sf_dir):
    return phrase_fingerprint.fingerprint_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return source_mix.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_secret_scans": op2_secret_scans,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ann": op5_ann,
    "op6_maxent_lm": op6_maxent_lm,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_phrase_fingerprints": op9_phrase_fingerprints,
    "op10_source_mix": op10_source_mix,
}
