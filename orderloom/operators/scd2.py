"""Dimensions that keep their history (slowly changing, type 2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.config import Dimension
from orderloom.functions import number_rows, rows_differ
from orderloom.operators.incremental import high_watermark, latest_by_key, literal_like
from orderloom.session import stage
from orderloom.sources.layers import BUCKET, bucket_of


Stage = Callable[[DataFrame, str], DataFrame]


def _versions(rows: DataFrame, dim: Dimension) -> DataFrame:
    """Source rows as open versions."""
    return rows.select(
        F.col(dim.surrogate).cast("bigint").alias(dim.surrogate), dim.key, *dim.attributes,
        F.col(dim.updated_at).alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
        F.lit(True).alias("is_current"),
    )


def _source(source: DataFrame, dim: Dimension) -> DataFrame:
    columns = source.select(dim.key, *dim.attributes, dim.updated_at)
    return latest_by_key(columns, dim.key, dim.updated_at)


def initial_load(source: DataFrame, dim: Dimension, stage: Stage = stage) -> DataFrame:
    """First versions, with surrogate keys 0, 1, ... in the order of the business key."""
    return _versions(number_rows(_source(source, dim), dim.key, dim.surrogate, stage=stage), dim)


def has_updates(target: DataFrame, source: DataFrame, dim: Dimension) -> bool:
    """Is any source row newer than the newest version? The gate before a full comparison."""
    newest = high_watermark(target, "start_date")
    if newest is None:
        return False
    later = F.col(dim.updated_at) > literal_like(source, dim.updated_at, newest)
    return not source.filter(later).isEmpty()


def changes(target: DataFrame, source: DataFrame, dim: Dimension) -> DataFrame:
    """Source rows whose current version is missing or differs; ``is_new`` tells which.

    Values are compared one by one, NULL-safe. Keys gone from the source are no change.
    """
    current = target.filter("is_current").select(
        F.col(dim.key).alias("_key"), *(F.col(a).alias(f"_{a}") for a in dim.attributes)
    )
    rows = _source(source, dim)
    joined = rows.join(current, F.col(dim.key) == F.col("_key"), "left")
    differs = rows_differ(
        [F.col(a) for a in dim.attributes], [F.col(f"_{a}") for a in dim.attributes]
    )
    return (
        joined.withColumn("is_new", F.col("_key").isNull())
        .filter(F.col("is_new") | differs)
        .select(*rows.columns, "is_new")
    )


def apply(
    target: DataFrame,
    source: DataFrame,
    dim: Dimension,
    as_of: str,
    stage: Stage = stage,
) -> DataFrame:
    """The dimension after taking in ``source``: changed versions closed on ``as_of``, new ones open.

    The changed rows are staged once, since their number, their keys and the rows themselves
    are all needed. Closed history passes through without a shuffle; only current versions,
    one per key, are matched.
    """
    changed = stage(changes(target, source, dim), f"{dim.name}-changes")
    history = target.filter("NOT is_current").select(dim.columns)
    return history.unionByName(_after(target.filter("is_current"), changed, target, dim, as_of, stage))


def merge(
    current: DataFrame, versions: DataFrame, source: DataFrame, dim: Dimension, as_of: str, stage: Stage = stage
) -> DataFrame:
    """What a merge of ``source`` writes: the current versions of the buckets with a changed key, and the versions closed.

    ``current`` holds the current versions with their buckets. Of all ``versions`` only the largest surrogate key is read.
    """
    changed = stage(changes(current, source, dim), f"{dim.name}-changes")
    touched = [r[0] for r in changed.select(bucket_of(dim.key)).distinct().collect()]  # at most the buckets there are
    return _after(current.filter(F.col(BUCKET).isin(touched)), changed, versions, dim, as_of, stage)


def _after(current: DataFrame, changed: DataFrame, target: DataFrame, dim: Dimension, as_of: str, stage: Stage) -> DataFrame:
    """``current`` versions, closed where ``changed`` replaces them, and the new ones, numbered on from ``target``."""
    top = target.agg(F.max(dim.surrogate)).first()[0]
    opened = _versions(number_rows(changed, dim.key, dim.surrogate, 0 if top is None else top + 1, stage), dim)
    replaced = changed.filter("NOT is_new").select(dim.key, F.lit(True).alias("_replaced"))
    kept = current.join(replaced, dim.key, "left").withColumns({
        "end_date": F.when(F.col("_replaced"), F.lit(as_of).cast("date")).otherwise(F.col("end_date")),
        "is_current": F.col("_replaced").isNull(),
    })
    return kept.select(dim.columns).unionByName(opened)
