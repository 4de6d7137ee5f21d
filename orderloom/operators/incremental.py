"""Loading only what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import date_parts
from orderloom.schemas import DATE_PARTS, LINE_COLUMNS


def high_watermark(df: DataFrame, ts: str) -> str | None:
    """Largest ``ts`` as text, which keeps microseconds and knows no time zone."""
    return df.agg(F.max(ts).cast("string")).first()[0]


def literal_like(df: DataFrame, column: str, text: str) -> Column:
    """``text`` as a constant of the column's own type, so comparisons reach the file scan."""
    return F.lit(text).cast(df.schema[column].dataType)


def newer_than(
    source: DataFrame,
    ts: str,
    lower: str | None,
    upper: str | None = None,
    ties: str = "strict",
    target: DataFrame | None = None,
    key: str | None = None,
) -> DataFrame:
    """Rows with ``lower < ts <= upper``; without ``lower`` all rows up to ``upper``.

    ``ties="anti"`` also takes rows at exactly ``lower`` whose ``key`` the target lacks. Only
    the target's rows of that one instant are looked at.
    """
    rows = source
    if upper is not None:
        rows = rows.filter(F.col(ts) <= literal_like(source, ts, upper))
    if lower is None:
        return rows
    bound = literal_like(source, ts, lower)
    if ties == "strict":
        return rows.filter(F.col(ts) > bound)
    if ties != "anti":
        raise ValueError(f"ties must be 'strict' or 'anti', not {ties!r}")
    loaded = target.filter(F.col(ts) == literal_like(target, ts, lower)).select(key, ts)
    return rows.filter(F.col(ts) >= bound).join(loaded, [key, ts], "left_anti")


def latest_by_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key: the one with the largest ``ts``.

    A plain maximum over (ts, other columns), so every task reduces its rows before the
    shuffle and a key with very many versions costs no more than any other. Equal ``ts`` are
    settled by the other columns, which keeps the choice repeatable.
    """
    rest = [c for c in df.columns if c not in (key, ts)]
    newest = df.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("newest"))
    return newest.select(key, "newest.*").select(df.columns)


def new_orders(
    orders: DataFrame, lower: str | None, upper: str | None = None, ts: str = "timestamp", **ties
) -> DataFrame:
    """New source orders with the date parts they will be laid out by."""
    return date_parts(newer_than(orders, ts, lower, upper, **ties), ts)


def lines_of(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of ``orders``, under the date of their order."""
    dated = orders.select(F.col("id").alias("order_id"), *DATE_PARTS)
    return lines.select(LINE_COLUMNS).join(dated, "order_id").select(*LINE_COLUMNS, *DATE_PARTS)


def without_lines(orders: DataFrame, loaded_lines: DataFrame) -> DataFrame:
    """Orders none of whose lines are loaded yet: makes a repeated line load harmless."""
    loaded = loaded_lines.select(F.col("order_id").alias("id")).distinct()
    return orders.join(loaded, "id", "left_anti").select(orders.columns)


def new_rows(table: DataFrame, lower: str | None, ts: str = "updated_at") -> DataFrame:
    """New rows of a reference table with date parts."""
    return date_parts(newer_than(table, ts, lower), ts)
