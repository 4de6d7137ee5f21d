"""Row-change feeds into plain events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.schemas import LINE_CHANGE, ORDER_CHANGE
from orderloom.sources.topics import parsed


def _rows(records: DataFrame, schema: str) -> DataFrame:
    """The row each record leaves behind. Deletions leave none and broken records say nothing."""
    payload = parsed(records, schema).select(F.col("data.payload").alias("p"))
    written = F.coalesce("p.op", F.lit("c")).isin("c", "r", "u")
    return payload.filter(written & F.col("p.after").isNotNull()).select(
        "p.after.*", F.coalesce(F.timestamp_millis("p.ts_ms"), F.current_timestamp()).alias("event_time")
    )


def _text(column: str | None) -> Column:
    return F.lit(None).cast("string") if column is None else F.col(column).cast("string").alias(column)


def order_events(records: DataFrame) -> DataFrame:
    return _rows(records, ORDER_CHANGE).select(
        F.lit("order").alias("kind"), F.col("id").alias("order_id"), _text("customer_id"),
        _text("payment_method_id"), "num_products", _text(None).alias("product_id"), "event_time",
    )


def line_events(records: DataFrame) -> DataFrame:
    return _rows(records, LINE_CHANGE).select(
        F.lit("line").alias("kind"), "order_id", _text(None).alias("customer_id"),
        _text(None).alias("payment_method_id"), F.lit(None).cast("int").alias("num_products"),
        "product_id", "event_time",
    )
