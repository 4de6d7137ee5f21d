"""Keys of suggestions that the conformed lines hold, by bucket, so that a repeat is known without reading old days.

The store follows the lines: whatever they gained since its newest day is taken in before it is asked. So it needs no
commit of its own with them, and a store that is gone is made again from the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.operators.clean import SUGGESTION_KEY, taken_suggestions, without_seen
from orderloom.schemas import DATE_PARTS
from orderloom.sources.files import has_data, list_dirs
from orderloom.sources.layers import append_partitioned, settle

BUCKETS = 16
LAYOUT = ("delivered", "bucket")
_SCHEMA = "order_id string, product_id string, is_suggestion boolean, delivered int, bucket int"


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*SUGGESTION_KEY), F.lit(BUCKETS)).cast("int")


def newest(spark: SparkSession, store: str) -> str | None:
    """Newest delivery day of which any suggestion is in the store."""
    found = list_dirs(spark, store, "delivered")
    return f"{found[0][0] // 10_000:04}-{found[0][0] // 100 % 100:02}-{found[0][0] % 100:02}" if found else None


def follow(spark: SparkSession, store: str, lines: DataFrame, suggestions: DataFrame) -> None:
    """Take in the suggestions among ``lines``. Both need not reach back beyond the store's newest day: delivery days never
    go back, and a suggestion's line lies under the day of its delivery."""
    settle(spark, store)
    day = newest(spark, store)
    taken = taken_suggestions(lines, suggestions).select(
        *SUGGESTION_KEY, F.expr("year * 10000 + month * 100 + day").alias("delivered"), _bucket().alias("bucket"))
    if day is not None:
        last = int(day.replace("-", ""))
        known = _read(spark, store).filter(F.col("delivered") == last)
        taken = without_seen(taken.filter(F.col("delivered") >= last), known)
    append_partitioned(taken, store, by=LAYOUT)  # asking for news first would match the lines twice


def unseen(spark: SparkSession, store: str, news: DataFrame) -> DataFrame:
    """The rows of ``news`` (staged: it is read twice) whose key the store lacks. Buckets without news are not read."""
    if not has_data(spark, store):
        return news
    touched = [r.bucket for r in news.select(_bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS numbers
    return without_seen(news, _read(spark, store).filter(F.col("bucket").isin(touched)))


def _read(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(store)
