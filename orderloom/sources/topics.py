"""JSON topics: Kafka, or folders of one JSON document per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.config import Endpoint


def read_topic(spark: SparkSession, topics: Endpoint, topic: str) -> DataFrame:
    """All records now in the topic, as one text column ``value``."""
    if topics.format == "kafka":
        options = {"startingOffsets": "earliest", **topics.options, "subscribe": topic}
        raw = spark.read.format("kafka").options(**options).load()
        return raw.select(F.col("value").cast("string"))
    return spark.read.option("recursiveFileLookup", True).text(f"{topics.path}/{topic}")


def stream_topic(spark: SparkSession, topics: Endpoint, topic: str, **options) -> DataFrame:
    """The topic as a stream of text values. Kafka starts at the newest record unless told otherwise."""
    if topics.format == "kafka":
        merged = {"startingOffsets": "latest", **topics.options, **options, "subscribe": topic}
        raw = spark.readStream.format("kafka").options(**merged).load()
        return raw.select(F.col("value").cast("string"))
    reader = spark.readStream.option("recursiveFileLookup", True).options(**options)
    return reader.text(f"{topics.path}/{topic}")


def parsed(records: DataFrame, schema: str) -> DataFrame:
    """JSON values as one struct column ``data``.

    Going through a one-element array keeps the optimizer from copying the parser into every
    later filter and column: each document is parsed once.
    """
    return records.select(F.explode(F.array(F.from_json("value", schema))).alias("data"))


def from_topic(records: DataFrame, schema: str) -> DataFrame:
    """Unpack JSON values. A broken document gives a row of NULLs, a bad field a NULL."""
    return parsed(records, schema).select("data.*")


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as JSON text, with a key so that one order stays in one partition."""
    value: Column = F.to_json(F.struct("*")).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def write_topic(df: DataFrame, topics: Endpoint, topic: str, key: str, batch: int | None = None) -> None:
    """Publish rows as JSON. For folders a numbered batch replaces an earlier try of itself."""
    if topics.format == "kafka":
        to_messages(df, key).write.format("kafka").options(**topics.options, topic=topic).save()
        return
    folder = f"{topics.path}/{topic}"
    target = folder if batch is None else f"{folder}/batch={batch}"
    to_messages(df).write.mode("append" if batch is None else "overwrite").text(target)
