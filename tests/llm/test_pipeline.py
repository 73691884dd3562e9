import corpus_pipeline
from conftest import DATA
from pyspark.sql import functions as F


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    leak = "password = hunter2hunter2"
    docs = docs.unionByName(docs.where("doc_id = 0").withColumn("text", F.concat("text", F.lit(f" {leak}"))).withColumn("doc_id", F.lit(90_000).cast("long")))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "secret scans", "source mix", "packing"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, DATA)
        assert out.columns == docs.columns, name
        left = spark.createDataFrame(out.collect(), docs.schema)
        assert left.where(F.col("text").contains(leak)).count() == 0 or name != "secret scans"
    packed = corpus_pipeline.pack(spark, left, DATA)
    assert packed.where("length > 0").select("doc_id").distinct().count() == left.select("doc_id").distinct().count()


def test_near_duplicates_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text), (2, text), (2, text), (3, text + " end"), (4, "something else"), (5, None), (6, ""), (None, "alone in the world"), (4, "another text of this id here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "mine") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")
    got = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert got.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == ["1", "4", "4", "5", "None"]


def test_stages_take_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, keep int, secret_spans string, taken int, fp int"
    rows = [(None, None, None, None, None, "s", 1, "x", 2, 3), (1, "", "", "", 0, None, None, None, None, None), (1, "one two three", "en", "a", 13, None, None, None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert name == "packing" or out.columns == docs.columns
            out.collect()
