"""Counts per key, kept beside a table that grows by day, so that checking keys reads new rows only."""

from __future__ import annotations

from collections.abc import Callable
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.sources.files import data_files, day_folders, has_data
from orderloom.sources.layers import append_partitioned, settle

Stage = Callable[[DataFrame, str], DataFrame]

BITS = 32_768  # bits of one bitmap: a fixed value of Spark's bitmap functions
BUCKETS = 64
SLOTS = 4_096

# One layout for all that a store holds; each kind of row uses its own columns.
_COLUMNS = {
    "kind": "string", "bucket": "int", "key": "string", "n": "bigint", "slot": "bigint", "bits": "binary",
    "rows": "bigint", "distinct": "bigint", "repeated": "bigint", "slots": "bigint", "day": "string", "file": "string",
}


def take_in(
    spark: SparkSession, store: str, table: str, column: str, stage: Stage, slots: int = SLOTS
) -> None:
    """Count the keys of the files that ``table`` has gained since the last time.

    ``table`` is laid out by date and grows at its end: news lie on the newest day counted or later, as they do
    behind a watermark. Rows are counted per key first, so a hot key is one row wherever it meets others. A
    sketch, one bit for each of ``slots * 32768`` hash values, tells which of the new keys may have been there
    before; only these meet the stored keys, bucket by bucket, and the stored keys decide. ``slots`` is chosen once
    for a store (about a tenth of the keys expected, in bits, makes nine of ten new keys pass); another value is an
    error. News are taken in as a whole or not at all (see ``append_partitioned``), each file once. NULL is a key like
    any other. A table that is written anew needs a new store.
    """
    settle(spark, store)
    files = _new_files(spark, store, table)
    if not files:
        return
    rows = spark.read.option("basePath", table).parquet(*(path for _, path in files))
    place = F.pmod(F.xxhash64("key"), F.lit(slots * BITS))
    counted = stage(
        rows.groupBy(F.col(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"bucket": F.pmod(F.xxhash64("key", F.lit(1)), F.lit(BUCKETS)).cast("int"),
                      "slot": F.floor(place / BITS), "bit": F.pmod(place, F.lit(BITS))}), "keys")
    before = F.coalesce("before", F.lit(0))
    totals = _with_history(spark, store, counted, stage, slots).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if((before == 0) & F.col("key").isNotNull()).alias("distinct"),
        F.count_if((before <= 1) & (before + F.col("n") > 1)).alias("repeated"),
        F.lit(slots).cast("bigint").alias("slots"),
    )
    sketch = counted.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
    seen = spark.createDataFrame(files, "day string, file string")
    parts = [_as(counted.select("bucket", "key", "n"), "keys"), _as(sketch, "sketch"), _as(totals, "totals"), _as(seen, "files")]
    gained = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    append_partitioned(gained, store, by=("kind", "bucket"))


def measured(spark: SparkSession, store: str) -> DataFrame:
    """Rows, distinct values and values that occur more than once, of all that was taken in."""
    return _kind(spark, store, "totals").agg(*(
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "distinct", "repeated")))


def _as(rows: DataFrame, kind: str) -> DataFrame:
    given = {"kind": F.lit(kind), **{c: F.col(c) for c in rows.columns}}
    given.setdefault("bucket", F.lit(0))
    return rows.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()))


def _kind(spark: SparkSession, store: str, kind: str) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())
    if not has_data(spark, f"{store}/kind={kind}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", store).parquet(f"{store}/kind={kind}")


def _new_files(spark: SparkSession, store: str, table: str) -> list[tuple[str, str]]:
    """(day, path) of the files not counted yet. Names of the newest counted day alone pass the driver."""
    counted = _kind(spark, store, "files")
    newest = counted.agg(F.max("day")).first()[0]
    known = {r.file for r in counted.filter(F.col("day") == newest).select("file").collect()} if newest else set()
    recent = takewhile(lambda found: newest is None or found[0] >= newest, day_folders(spark, table))
    return [(day, path) for day, folder in recent for path in data_files(spark, folder) if path not in known]


def _with_history(spark: SparkSession, store: str, counted: DataFrame, stage: Stage, slots: int) -> DataFrame:
    """``counted`` and how often each key was there ``before``, NULL where the key is new."""
    if not has_data(spark, store):
        return counted.withColumn("before", F.lit(None).cast("bigint"))
    made_with = _kind(spark, store, "totals").agg(F.max("slots")).first()[0]
    if made_with != slots:
        raise ValueError(f"{store} was made with {made_with} slots, not {slots}")
    hit = counted.select("slot").distinct()
    sketch = (
        _kind(spark, store, "sketch").select("slot", "bits").join(hit, "slot", "left_semi")
        .groupBy("slot").agg(F.bitmap_or_agg("bits").alias("bits")))
    maybe = stage(counted.join(sketch, "slot").filter(_bit("bits", "bit")).select("bucket", "key"), "maybe")
    stored = _kind(spark, store, "keys").select("bucket", "key", "n").alias("s")
    same = (F.col("s.bucket") == F.col("m.bucket")) & F.col("s.key").eqNullSafe(F.col("m.key"))
    found = (
        stored.join(maybe.alias("m"), same).groupBy(F.col("s.key").alias("known"))
        .agg(F.sum("s.n").alias("before")))
    return counted.join(found, F.col("key").eqNullSafe(F.col("known")), "left").drop("known")


def _bit(bits: str, place: str) -> Column:
    """Is the bit at ``place`` set? Byte ``place div 8``, lowest bit first."""
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(F.col(place) / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), F.pmod(F.col(place), F.lit(8)).cast("int")) == 1
