"""Shared pieces: tables, staging in the shared folder, text lookups inside tasks, components."""

from __future__ import annotations

from sys import getsizeof

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.session import stage

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Written to the folder in ``spark.checkpoint.dir`` and read back: executors may come and go."""
    return stage(df, label)


def bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``. A NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.transform(F.array(value), body)[0]


def _bytes(value) -> int:
    return getsizeof(value) + (sum(map(getsizeof, value)) if isinstance(value, tuple) else 0)


class Remembered(dict):
    """Answers by key, worked out on first use. What is held is measured: at most ``most`` bytes, in two
    generations, of which the older goes when the younger is full, so what is asked for often stays. Single
    keys that take a thousandth of that are not held: long texts do not drive short ones out."""

    ENTRY = 100  # bytes of a dictionary for one entry

    def __init__(self, work, most: int = 200_000_000):
        super().__init__()
        self.work, self.most, self.held = work, most, 0
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.work(key)
        size = self.ENTRY + _bytes(key) + _bytes(value)
        if size * 1000 > self.most:
            return value
        if self.held + size > self.most // 2:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[key] = value
        return value


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node that has a link in ``edges`` (a, b); root is the smallest node reachable.

    Large-star and small-star steps take turns until nothing changes. Each step is a minimum per node,
    reduced before the shuffle, and a join; its rows are at most the links. Steps are written to the
    shared folder, which cuts lineage.
    """
    links = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{label}-links",
    )
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = staged(
            small.union(least.select("u", F.col("m").alias("v"))).where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
            f"{label}-links",
        )
        now = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
