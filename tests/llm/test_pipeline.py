"""The stages one by one and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.01"


def test_stages_hand_documents_on(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns and 0 < after.count() < before
        assert after.exceptAll(docs).count() == 0
        docs, before = after, after.count()
    kept = docs.join(labels, "doc_id")
    assert kept.where("toxic = 1").count() <= 0.3 * labels.where("toxic = 1").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == before


def test_odd_documents(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    text = "A plain text of usual words that goes on and on. " * 3 + " ".join(f"Word{i} follows." for i in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (3, None, "en", "s", 1), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema).withColumns({"kept": F.lit(1), "n_words": F.lit("x"), "votes": F.lit(None).cast("string"),
        **{c: F.lit("mine") for c in ("_toxicity", "score", "row", "_row", "_first_id", "first_id", "digest", "id", "n", "key")}})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
    assert [r.doc_id for r in corpus_pipeline.quality(spark, docs, FOLDER).collect()] == [1, 1, 2]
    assert sorted((r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()), key=str) == [1, 3]


def test_every_group_of_copies_keeps_one_document(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[2]), (9, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x"))
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=lambda r: r[1]) == [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3])]


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").where("length <= 0").count() == 0
