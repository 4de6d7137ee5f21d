"""Reading and writing the layers."""

from __future__ import annotations

import uuid
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.schemas import DATE_PARTS
from orderloom.sources.files import day_folders, delete, exists, has_data, list_dirs, mark, move_below


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def countable(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table for counts and minima: Spark answers ``count(*)``, ``count(column)`` and ``min`` of a number from
    the file footers, without reading rows. Anything else reads the columns it names. To be asked through a
    session beside the caller's, as the setting holds for a whole session."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(path)


def read_since(spark: SparkSession, path: str, day: str | None) -> DataFrame:
    """A table laid out by date, from ``day`` on. Only the folders of those days are listed and
    read, so the cost follows the news and not the history."""
    if day is None:
        return read_layer(spark, path)
    recent = takewhile(lambda found: found[0] >= day, day_folders(spark, path))
    days = [folder for _, folder in recent if has_data(spark, folder)]
    if not days:
        return read_layer(spark, path).filter("false")
    return spark.read.option("basePath", path).parquet(*days)


COMMITTED = "_COMMITTED"
PENDING = "_pending"  # readers pass over names with an underscore


def append_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = DATE_PARTS) -> None:
    """Append by year, month and day, or by other columns, all of it or nothing.

    The rows are written beside the table and committed by one small file, and only then moved
    in. What an interruption leaves is settled by ``settle``: a committed append is
    moved in to its end, any other is dropped.

    The rebalance hint gathers each day's rows so that no task writes a sliver into every
    folder, and splits a day that is too large for one task over several.
    """
    spark, pending = df.sparkSession, f"{path}/{PENDING}"
    if exists(spark, f"{pending}/{COMMITTED}"):
        raise RuntimeError(f"{path} holds a committed append; settle it before reading what to append")
    delete(spark, pending)
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(f"{pending}/data")
    mark(spark, f"{pending}/{COMMITTED}")
    settle(spark, path)


def settle(spark: SparkSession, path: str) -> None:
    """End a write that was cut short. To be called before a table is read, by whatever step."""
    pending = f"{path}/{PENDING}"
    if not exists(spark, pending):
        return
    if exists(spark, f"{pending}/{COMMITTED}"):
        if exists(spark, f"{pending}/{MERGE}"):
            _replace_partitions(spark, f"{pending}/{MERGE}", path)
        else:
            move_below(spark, f"{pending}/data", path)
    delete(spark, pending)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a table that ``df`` does not itself read."""
    df.write.mode("overwrite").parquet(path)


# Merged tables: versions by whether they are current, by a bucket of their key, and, once closed, by the merge
# that closed them. A merge writes the current partitions of the buckets it changes and one new closed
# partition for each; all other files stay as they are.

MERGE = "merge"
STATE, BUCKET, CLOSED_BY = "v_state", "v_bucket", "v_merge"
LAYOUT = (STATE, BUCKET, CLOSED_BY)
BUCKETS = 16
_OPEN = "open"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _laid_out(df: DataFrame, key: str, merge: str) -> DataFrame:
    current = F.col("is_current")
    return df.withColumns({
        STATE: F.when(current, "current").otherwise("closed"), BUCKET: bucket_of(key),
        CLOSED_BY: F.when(current, _OPEN).otherwise(merge),
    })


def merge_versions(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Write the partitions that ``rows`` belong to: current versions replace those of their bucket, closed ones
    are added. ``rows`` may read the table. All of it or nothing: the rows are written beside the table and
    committed, and putting them in place may be repeated (see ``settle``)."""
    pending = f"{path}/{PENDING}"
    if exists(spark, f"{pending}/{COMMITTED}"):
        raise RuntimeError(f"{path} holds a committed merge; settle it before reading what to merge")
    delete(spark, pending)
    _laid_out(rows, key, f"m{uuid.uuid4().hex}").hint("rebalance", *LAYOUT).write.partitionBy(*LAYOUT).parquet(f"{pending}/{MERGE}")
    mark(spark, f"{pending}/{COMMITTED}")
    settle(spark, path)


def _replace_partitions(spark: SparkSession, source: str, path: str) -> None:
    """Dynamic partition overwrite. The rows replaced have been read before: ``source`` does not depend on them."""
    if has_data(spark, source):
        rows = spark.read.parquet(source).withColumn(CLOSED_BY, F.col(CLOSED_BY).cast("string"))
        rows.hint("rebalance", *LAYOUT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def read_merged(spark: SparkSession, path: str, current: bool = False) -> DataFrame:
    """All versions, or only the folders of the current ones."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col(STATE) == "current") if current else rows


def read_versioned(spark: SparkSession, path: str, table_format: str = "snapshot", current: bool = False) -> DataFrame:
    """The present state of a versioned table. With ``current`` closed versions may be left out."""
    if table_format == "merged":
        return read_merged(spark, path, current).drop(*LAYOUT)
    if table_format != "snapshot":
        return spark.read.format(table_format).load(path)
    return spark.read.parquet(_newest_snapshot(spark, path))


def countable_versioned(spark: SparkSession, path: str, table_format: str = "snapshot") -> DataFrame:
    """As ``countable``, for a versioned table; a transactional format answers counts in its own way."""
    if table_format == "merged":
        return countable(spark, path).drop(*LAYOUT)
    if table_format != "snapshot":
        return read_versioned(spark, path, table_format)
    return countable(spark, _newest_snapshot(spark, path))


def _newest_snapshot(spark: SparkSession, path: str) -> str:
    complete = _complete_snapshots(spark, path)
    if not complete:
        raise FileNotFoundError(f"no complete snapshot below {path}")
    return complete[0][1]


def versioned_exists(spark: SparkSession, path: str, table_format: str = "snapshot") -> bool:
    if table_format == "merged":
        return has_data(spark, path)
    if table_format != "snapshot":
        return exists(spark, path)
    return bool(_complete_snapshots(spark, path))


def write_versioned(df: DataFrame, path: str, table_format: str = "snapshot", keep: int = 2, key: str | None = None) -> None:
    """Replace a versioned table. ``df`` may read the table it replaces.

    A snapshot counts once its commit file is there, written after its data, so readers see the
    old state or the new one and a failed write leaves the old one in place. The newest ``keep``
    committed states stay; older ones and remains of failed writes before them go.
    """
    if table_format == "merged":
        merge_versions(df.sparkSession, path, df, key)
        return
    if table_format != "snapshot":
        df.write.format(table_format).mode("overwrite").save(path)
        return
    spark = df.sparkSession
    taken = list_dirs(spark, path, "snapshot")
    number = taken[0][0] + 1 if taken else 1
    df.write.parquet(f"{path}/snapshot={number}")
    mark(spark, f"{path}/snapshot={number}/{COMMITTED}")
    complete = _complete_snapshots(spark, path)
    if not complete or complete[0][0] < number:
        raise RuntimeError(f"snapshot {number} of {path} was not committed")
    kept = {n for n, _ in complete[:keep]}
    for n, folder in list_dirs(spark, path, "snapshot"):
        if n < number and n not in kept:
            delete(spark, folder)


def _complete_snapshots(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    return [(n, p) for n, p in list_dirs(spark, path, "snapshot") if exists(spark, f"{p}/{COMMITTED}")]
