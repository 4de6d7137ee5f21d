"""Comma-separated seed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.schemas import SOURCE_TABLES

BROKEN = "_broken"


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows by column position below a header line; a line that does not fit is whole in ``BROKEN``."""
    columns = SOURCE_TABLES[table].rsplit(", updated_at", 1)[0]
    return (
        spark.read.schema(f"{columns}, {BROKEN} string")
        .option("header", True).option("enforceSchema", True).option("quote", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
        .csv(path)
    )


def _stamp(as_of: str | None):
    return (F.current_timestamp() if as_of is None else F.lit(as_of)).cast("timestamp_ntz")


def read_csv_dimension(spark: SparkSession, path: str, table: str, as_of: str | None = None) -> DataFrame:
    """The lines that fit ``table``, with ``updated_at`` stamped. ``csv_rejects`` gives the others."""
    rows = _read(spark, path, table)
    return rows.filter(F.col(BROKEN).isNull()).drop(BROKEN).withColumn("updated_at", _stamp(as_of))


def csv_rejects(spark: SparkSession, path: str, table: str, as_of: str | None = None) -> DataFrame:
    """The lines that do not fit: too few or too many columns, or text where a number belongs."""
    rows = _read(spark, path, table).select("*", F.col("_metadata.file_path").alias("_file"))
    # Only where all columns are read does the reader find every line that does not fit.
    kept = F.when(F.length(F.concat_ws("", *(F.col(c).cast("string") for c in rows.columns))) >= 0, F.col(BROKEN))
    return rows.select(
        F.lit(table).alias("table_name"), kept.alias("line"), F.col("_file").alias("file"), _stamp(as_of).alias("rejected_at"),
    ).filter("line IS NOT NULL")
