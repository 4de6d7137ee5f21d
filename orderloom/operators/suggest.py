"""From complete orders to product suggestions. Works on batches and inside micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions import hash_slice, is_present, number_rows
from orderloom.schemas import ACCEPTED_SUGGESTION, SUGGESTION


def diamond_customers(customers: DataFrame) -> DataFrame:
    return customers.filter(F.col("tier") == "diamond").select("id")


def acb_methods(methods: DataFrame) -> DataFrame:
    """Payment methods of the partner bank: all of them, in contrast to the first found."""
    return methods.filter(F.col("bank").like("%ACB%")).select("id")


def product_catalogue(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "unit_price"
    )


def assemble_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders whose distinct products number exactly what the order announced.

    Repeated lines are removed before products are gathered, on (order, product), so an order
    with very many lines is spread over tasks; what meets in one row is at most the catalogue,
    and is the message itself.
    """
    gathered = (
        lines.select("order_id", "product_id").distinct()
        .groupBy("order_id").agg(F.sort_array(F.collect_list("product_id")).alias("product_ids"))
    )
    return (
        orders.select(F.col("id").alias("order_id"), "customer_id", "payment_method_id", "num_products")
        .join(gathered, "order_id", "left")
        .withColumn("product_ids", F.coalesce("product_ids", F.array().cast("array<string>")))
        .filter(F.size("product_ids") == F.col("num_products"))
        .select(
            "order_id", F.col("customer_id").cast("string").alias("customer_id"),
            F.col("payment_method_id").cast("string").alias("payment_method_id"), "product_ids",
        )
    )


def eligible_orders(ready: DataFrame, customers: DataFrame, methods: DataFrame) -> DataFrame:
    """Orders of a diamond customer paid through the partner bank.

    ``customers`` and ``methods`` hold the admitted ids. The method filter comes first: it is
    the smaller set and removes most orders before they meet the customer list.
    """

    def admitted(ids: DataFrame, name: str) -> DataFrame:
        return ids.select(F.col("id").cast("string").alias(name))

    return (
        ready.filter(is_present(ready, "customer_id") & is_present(ready, "payment_method_id"))
        .withColumns({c: F.col(c).cast("string") for c in ("customer_id", "payment_method_id")})
        .join(admitted(methods, "payment_method_id"), "payment_method_id", "left_semi")
        .join(admitted(customers, "customer_id"), "customer_id", "left_semi")
        .select(ready.columns)
    )


def numbered_catalogue(catalogue: DataFrame) -> DataFrame:
    """The catalogue with numbers from 0 in id order."""
    return number_rows(catalogue, "product_id", "number")


def recommend(eligible: DataFrame, catalogue: DataFrame, size: int | None = None) -> DataFrame:
    """One product the order does not hold yet, at 20 to 50 percent off; none if it holds all.

    The choice is the n-th free product in id order, n drawn from the md5 of the order id. With
    the catalogue numbered, n is moved past the numbers the order already holds, so neither the
    catalogue nor a list of candidates is ever built per order. With ``size`` given, ``catalogue`` is numbered
    already and holds that many products.
    """
    numbered = numbered_catalogue(catalogue) if size is None else catalogue
    size = catalogue.count() if size is None else size
    held = (
        eligible.select("order_id", F.explode_outer("product_ids").alias("product_id"))
        .join(numbered.select("product_id", "number"), "product_id", "left")
        .groupBy("order_id").agg(F.array_sort(F.collect_set("number")).alias("held"))
    )
    free = F.lit(size).cast("bigint") - F.size("held")
    number = F.aggregate(
        "held", F.pmod(hash_slice("order_id", 1), "free"),
        lambda at, taken: F.when(taken <= at, at + 1).otherwise(at),
    )
    discount = F.lit(20) + F.pmod(hash_slice("order_id", 8), F.lit(31)).cast("int")
    return (
        held.withColumn("free", free).filter("free > 0")
        .select("order_id", number.alias("number"), discount.alias("discount_percent"))
        .join(numbered, "number")
        .select(
            "order_id", "product_id", "product_name", F.lit(1).alias("quantity"), "unit_price",
            "discount_percent",
            F.expr("cast(cast(unit_price as bigint) * (100 - discount_percent) div 100 as int)").alias("subtotal"),
            F.lit(True).alias("is_suggestion"),
        )
    )


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


SUGGESTION_COLUMNS = _names(SUGGESTION)
ACCEPTED_COLUMNS = _names(ACCEPTED_SUGGESTION)


def accepted(suggestions: DataFrame) -> DataFrame:
    """Every suggestion counts as accepted."""
    return suggestions.select(ACCEPTED_COLUMNS)
