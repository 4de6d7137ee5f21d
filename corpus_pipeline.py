"""Stages that turn ``documents`` into packed training sequences.

Each function takes (spark, docs, sf_dir) and returns rows that are written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents`` with the documents kept.
NULL texts count as empty, extra columns pass through, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import packing, simhash, weak_rules
from orderloom.llm.common import staged, table
from orderloom.llm.queries import TOXIC, WORDS, toxicity_model


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, text): all columns within one, so that no name of theirs can clash."""
    return docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit. Labels are learned from as in the query of the operator."""
    model = toxicity_model(spark, sf_dir)
    return model.score(whole_rows(docs), "text", "score").where(F.col("score") < TOXIC).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep. Texts are measured once, and the measures staged with their rows."""
    measured = staged(weak_rules.measure(whole_rows(docs), keep=("row",)), "pipeline-measures")
    return weak_rules.judge(measured, weak_rules.fit(measured)).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (NULL is largest), then text digest.

    Rows are told apart by id and text; only rows that repeat both are one document.
    """
    id, digest = F.col("doc_id"), F.md5("text")
    key = F.struct(id.isNull().alias("gone"), id.alias("id"), digest.alias("digest"))
    classes = simhash.near_duplicates(docs.select(key.alias("key"), "text"), id="key")
    first = classes.where("key = component_id").groupBy("key").agg(F.count("*").alias("n"))
    first = staged(first.select(F.col("key.id").alias("first_id"), F.col("key.digest").alias("first_digest"), "n"), "pipeline-first")
    keyed = docs.select(F.struct("*").alias("row"), id.alias("id"), digest.alias("digest"))
    same = F.col("id").eqNullSafe(F.col("first_id")) & F.col("digest").eqNullSafe(F.col("first_digest"))
    single = keyed.join(first.where("n = 1"), same, "left_semi")
    repeated = keyed.join(first.where("n > 1"), same, "left_semi").dropDuplicates(["id", "digest"])
    return single.select("row.*").unionByName(repeated.select("row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, public_tokenizers.path(WORDS))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Learned models, expectation-maximisation and retrieval have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
