"""Raw tables into clean, denormalised ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions import strip_cr, text_or_null
from orderloom.operators.incremental import latest_by_key
from orderloom.schemas import DATE_PARTS, LINE_COLUMNS


def clean_stores(stores: DataFrame) -> DataFrame:
    return latest_by_key(stores, "id", "updated_at").select(
        F.col("id").alias("store_id"), F.col("name").alias("store_name"),
        "address", "district", strip_cr("city").alias("city"), "updated_at",
    )


def clean_products(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products with the name of their category; products of unknown category stay."""
    named = latest_by_key(categories.select("id", "name", "updated_at"), "id", "updated_at").select(
        F.col("id").alias("category_id"), F.col("name").alias("category")
    )
    return (
        latest_by_key(products, "id", "updated_at")
        .join(named, "category_id", "left")
        .select(
            F.col("id").alias("product_id"), F.col("name").alias("product_name"),
            "category", "unit_price", "updated_at",
        )
    )


def clean_payment_methods(methods: DataFrame) -> DataFrame:
    """The text ``null`` becomes NULL; every other column is kept."""
    return (
        latest_by_key(methods, "id", "updated_at")
        .withColumn("bank", text_or_null("bank"))
        .withColumnsRenamed({"id": "method_id", "name": "method_name"})
    )


def clean_customers(customers: DataFrame) -> DataFrame:
    return latest_by_key(customers, "id", "updated_at")


def clean_orders(orders: DataFrame) -> DataFrame:
    return orders.withColumnRenamed("id", "order_id")


SUGGESTION_KEY = ["order_id", "product_id", "is_suggestion"]


def unseen_suggestions(
    suggestions: DataFrame, loaded_lines: DataFrame | None = None, since: str | None = None
) -> DataFrame:
    """One row per suggestion that is not among ``loaded_lines`` yet.

    Topics deliver at least once, so a suggestion may arrive again; the repeat is recognised
    by (order, product, flag), with NULLs matching NULLs, and the earliest delivery stands.
    With ``since``, suggestions first delivered before that day count as loaded and
    ``loaded_lines`` need not reach further back.
    """
    rest = [c for c in suggestions.columns if c not in SUGGESTION_KEY]
    ordered = [*DATE_PARTS, *(c for c in rest if c not in DATE_PARTS)]
    once = (
        suggestions.groupBy(*SUGGESTION_KEY).agg(F.min(F.struct(*ordered)).alias("first"))
        .select(*SUGGESTION_KEY, "first.*")
    )
    if since is not None:
        once = once.filter(F.make_date(*DATE_PARTS) >= F.lit(since).cast("date"))
    if loaded_lines is not None:
        once = _without(once, loaded_lines)
    return once.select(*LINE_COLUMNS, *DATE_PARTS)


def _without(suggestions: DataFrame, loaded_lines: DataFrame) -> DataFrame:
    return without_seen(suggestions, loaded_lines.filter("is_suggestion OR is_suggestion IS NULL"))


def _matching(rows: DataFrame, others: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) an equal among ``others``; NULLs match NULLs."""
    listed = others.select(*(F.col(c).alias(f"seen_{c}") for c in columns)).distinct()
    matches = F.lit(True)
    for c in columns:
        matches = matches & F.col(c).eqNullSafe(F.col(f"seen_{c}"))
    return rows.join(listed, matches, how)


def without_seen(suggestions: DataFrame, seen: DataFrame) -> DataFrame:
    return _matching(suggestions, seen, SUGGESTION_KEY, "left_anti")


def taken_suggestions(lines: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Keys and days of the lines that came as suggestions: those lie under the day of their delivery."""
    keys = lines.select(*SUGGESTION_KEY, *DATE_PARTS)
    return _matching(keys, suggestions, [*SUGGESTION_KEY, *DATE_PARTS], "left_semi").distinct()


def own_lines(loaded_lines: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Loaded lines that came with their order, not as a suggestion."""
    keys = suggestions.select(SUGGESTION_KEY).distinct()
    return loaded_lines.join(keys, SUGGESTION_KEY, "left_anti")


def clean_lines(
    orders: DataFrame,
    lines: DataFrame,
    suggestions: DataFrame,
    loaded_lines: DataFrame | None = None,
    since: str | None = None,
) -> DataFrame:
    """Lines of the new orders, and every suggestion not loaded before."""
    return lines_among(orders, lines).unionByName(unseen_suggestions(suggestions, loaded_lines, since))


def lines_among(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines whose order is one of ``orders``."""
    return (
        lines.select(*LINE_COLUMNS, *DATE_PARTS)
        .join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
        .select(*LINE_COLUMNS, *DATE_PARTS)
    )
