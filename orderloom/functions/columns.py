"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip_cr(column: str | Column) -> Column:
    """Without a carriage return at the end."""
    return F.regexp_replace(column, r"\r$", "")


def text_or_null(column: str) -> Column:
    """``strip_cr``, with the text ``null`` read as NULL."""
    return F.when(F.col(column).isin("null", "null\r"), F.lit(None)).otherwise(strip_cr(column))


def date_parts(df: DataFrame, ts: str | Column) -> DataFrame:
    """Add the year, month and day that the tables are laid out by."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})


def rows_differ(left: list[Column], right: list[Column]) -> Column:
    """True if any pair differs. NULL equals NULL and differs from everything else."""
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & a.eqNullSafe(b)
    return ~same


def is_present(df: DataFrame, column: str) -> Column:
    """Neither NULL nor empty; for numbers neither NULL nor zero."""
    value = F.col(column)
    blank = "" if isinstance(df.schema[column].dataType, T.StringType) else 0
    return value.isNotNull() & (value != F.lit(blank))


def hash_slice(column: str | Column, start: int) -> Column:
    """Seven hex digits of the md5 from ``start`` (1-based) as a bigint: repeatable on any engine."""
    return F.conv(F.substring(F.md5(column), start, 7), 16, 10).cast("bigint")
