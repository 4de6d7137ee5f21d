"""Source tables: a database over JDBC, or files of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.config import Endpoint


def jdbc_options(source: Endpoint, table: str, since: str | None = None) -> dict[str, str]:
    """Reader options for one table.

    ``table_options[table]`` may hold ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` so that the read is spread over tasks instead of coming through one
    connection, and ``since_query``, a SELECT with ``{since}`` in it that the database answers
    in place of the whole table once there is a watermark. Date-times stay free of time zones.
    """
    own = source.table_options.get(table, {})
    extra = {k: v for k, v in own.items() if k not in ("predicates", "since_query")}
    if since is not None and "since_query" in own:
        table = f"({own['since_query'].format(since=since)}) recent"
    return {"preferTimestampNTZ": "true", "fetchsize": "10000", **source.options, **extra, "dbtable": table}


def read_table(spark: SparkSession, source: Endpoint, table: str, since: str | None = None) -> DataFrame:
    """A source table; with ``since`` at least the rows that belong to that time or later."""
    if source.format != "jdbc":
        return spark.read.format(source.format).options(**source.options).load(f"{source.path}/{table}")
    options = jdbc_options(source, table, since)
    predicates = source.table_options.get(table, {}).get("predicates")
    if predicates:  # tables without a numeric or time column: one task per predicate
        url = options.pop("url")
        return spark.read.jdbc(url, options.pop("dbtable"), predicates=predicates, properties=options)
    return spark.read.format("jdbc").options(**options).load()


def append_table(source: Endpoint, table: str, rows: DataFrame) -> None:
    """Add rows to a source table."""
    writer = rows.write.mode("append").format(source.format).options(**source.options)
    if source.format == "jdbc":
        writer.option("dbtable", table).save()
    else:
        writer.save(f"{source.path}/{table}")
