"""The order-line fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.operators.incremental import literal_like, newer_than


def orders_after(
    orders: DataFrame, after: str | None, grain: str = "timestamp", **ties
) -> DataFrame:
    """Orders not in the fact yet.

    ``grain="day"`` compares the order's *day* with the full watermark, which leaves out later
    orders of a day that is already partly loaded.
    """
    if after is None:
        return orders
    if grain == "day":
        return orders.filter(F.to_date("timestamp") > literal_like(orders, "timestamp", after))
    if grain != "timestamp":
        raise ValueError(f"grain must be 'timestamp' or 'day', not {grain!r}")
    return newer_than(orders, "timestamp", after, **ties)


def build_fact(
    orders: DataFrame, lines: DataFrame, products: DataFrame, stores: DataFrame, methods: DataFrame
) -> DataFrame:
    """One row per order line under the keys of the current dimension versions.

    Lines whose product, store or method has no current version are left out. The order and
    line tables meet in one shuffle on the order; the dimensions arrive as two narrow columns
    each, which Spark broadcasts while they measure below its threshold and shuffles beyond.
    """
    heads = orders.select(
        "order_id", F.col("timestamp").alias("order_date"), "customer_id",
        "store_id", F.col("payment_method_id").alias("method_id"), "year", "month", "day",
    )
    details = lines.select("order_id", "product_id", "quantity", "subtotal")
    return (
        heads.join(_keys(stores, "store_key", "store_id"), "store_id")
        .join(_keys(methods, "method_key", "method_id"), "method_id")
        .join(details, "order_id")
        .join(_keys(products, "product_key", "product_id"), "product_id")
        .select(
            "year", "month", "day", "order_date", "order_id", "customer_id", "store_key",
            F.col("method_key").alias("payment_method_key"), "product_key", "quantity", "subtotal",
        )
    )


def _keys(dimension: DataFrame, surrogate: str, key: str) -> DataFrame:
    return dimension.filter("is_current").select(surrogate, key)
