"""The given test tables, re-shaped into the source tables this package works on."""

from __future__ import annotations

from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions import number_rows

T0 = "2024-01-01 00:00:00"  # last update of every reference row
T1 = "2024-01-31 00:00:00"  # update of the changed rows, 30 days later
CUTOFF = "2001-01-01 00:00:00"  # orders before it count as loaded
AS_OF = "2001-08-02"


class DriverTables:
    """Lazy source tables over one folder of test data."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.raw = cache(self._read)  # one file listing per table

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @staticmethod
    def stamp(text: str = T0):
        return F.lit(text).cast("timestamp_ntz")

    def stores(self) -> DataFrame:
        city = F.when(F.col("s_suppkey") % 3 == 0, F.concat("r_name", F.lit("\r"))).otherwise(F.col("r_name"))
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("name"),
                F.concat(F.lit("Addr "), F.col("s_suppkey").cast("string")).alias("address"),
                F.col("n_name").alias("district"), city.alias("city"), self.stamp().alias("updated_at"),
            )
        )

    def payment_method(self) -> DataFrame:
        digit = F.substring("o_orderpriority", 1, 1).cast("int")
        names = F.array(*(F.lit(v) for v in ("cash", "credit", "bank transfer", "bank transfer", "bank transfer")))
        banks = F.array(*(F.lit(v) for v in ("null", "null\r", "ACB\r", "BIDV", "MB Bank")))
        return self.raw("orders").select(digit.alias("id")).distinct().select(
            "id", F.element_at(names, F.col("id")).alias("method_name"),
            F.element_at(banks, F.col("id")).alias("bank"), self.stamp().alias("updated_at"),
        )

    def product_category(self) -> DataFrame:
        return self._categories

    @cached_property
    def _categories(self) -> DataFrame:
        names = self.raw("part").select(F.col("p_type").alias("name")).distinct()
        return number_rows(names, "name", "id", start=1).select(
            F.col("id").cast("int").alias("id"), "name", self.stamp().alias("updated_at")
        )

    def products(self) -> DataFrame:
        categories = self.product_category().select(F.col("id").alias("category_id"), F.col("name").alias("p_type"))
        return self.raw("part").join(categories, "p_type").select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"),
            "category_id", F.floor("p_retailprice").cast("int").alias("unit_price"),
            self.stamp().alias("updated_at"),
        )

    def customers(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        tier = (
            F.when(segment == "BUILDING", "diamond").when(segment == "AUTOMOBILE", "gold")
            .when(segment == "MACHINERY", "silver").otherwise("regular")
        )
        return self.raw("customer").select(
            F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("name"),
            F.lit(0).alias("phone_number"), tier.alias("tier"), self.stamp().alias("updated_at"),
        )

    def orders(self) -> DataFrame:
        counts = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
        return self.raw("orders").join(counts, "o_orderkey", "left").select(
            F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("timestamp"),
            F.col("o_custkey").cast("int").alias("customer_id"),
            (F.col("o_custkey") % self._store_count).cast("int").alias("store_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_method_id"),
            F.coalesce("n", F.lit(0)).cast("int").alias("num_products"),
        )

    @cached_property
    def _store_count(self) -> int:
        return self.raw("supplier").count()

    def order_details(self) -> DataFrame:
        paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return self.raw("lineitem").select(
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"),
            F.floor("l_quantity").cast("int").alias("quantity"),
            F.round(F.col("l_discount") * 100).cast("int").alias("discount_percent"),
            F.floor(paid).cast("int").alias("subtotal"),
            (F.col("l_returnflag") == "R").alias("is_suggestion"),
        )

    def suggestion_records(self) -> DataFrame:
        """Topic text made of the events: error events are cut short, signup events carry a
        quantity that is no number, and click events are delivered twice."""
        message = F.to_json(F.struct(
            F.col("event_id").cast("string").alias("order_id"),
            F.concat(F.lit("P"), F.get_json_object("props", "$.k")).alias("product_id"),
            F.lit(1).alias("quantity"), (20 + F.col("user_id") % 31).cast("int").alias("discount_percent"),
            F.floor(F.col("value") * 100).cast("int").alias("subtotal"), F.lit(True).alias("is_suggestion"),
        ))
        text = (
            F.when(F.col("event_type") == "error", F.substring(message, 1, 25))
            .when(F.col("event_type") == "signup", F.replace(message, F.lit('"quantity":1'), F.lit('"quantity":"one"')))
            .otherwise(message)
        )
        copies = F.when(F.col("event_type") == "click", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        records = self.raw("events").select("event_type", text.alias("value"))
        return records.withColumn("delivery", F.explode(copies))

    # Two versions of each dimension source: some rows change, some are new in the second
    # version, one is gone from it.

    def products_v1(self) -> DataFrame:
        """Raw products before the update: keys divisible by 7 do not exist yet."""
        return self.products().filter(self._number("id", 2) % 7 != 0)

    def products_v2(self) -> DataFrame:
        number = self._number("id", 2)
        changed = number % 10 == 0
        return self.products().filter(number != 3).withColumns({
            "unit_price": F.col("unit_price") + F.when(changed, 1000).otherwise(0),
            "updated_at": F.when(changed, self.stamp(T1)).otherwise(self.stamp()),
        })

    def stores_v1(self) -> DataFrame:
        return self.stores().filter(F.col("id") % 7 != 0)

    def stores_v2(self) -> DataFrame:
        """Changed stores swap address and district: the same values under other columns."""
        changed = F.col("id") % 10 == 0
        return self.stores().filter("id <> 3").withColumns({
            "address": F.when(changed, F.col("district")).otherwise(F.col("address")),
            "district": F.when(changed, F.col("address")).otherwise(F.col("district")),
            "updated_at": F.when(changed, self.stamp(T1)).otherwise(self.stamp()),
        })

    def payment_method_v1(self) -> DataFrame:
        return self.payment_method().filter("id <> 5")

    def payment_method_v2(self) -> DataFrame:
        """Method 1 gains a bank, method 4 loses it, method 2 is gone, method 5 is new."""
        return self.payment_method().filter("id <> 2").withColumns({
            "bank": F.when(F.col("id") == 1, "VCB").when(F.col("id") == 4, "null").otherwise(F.col("bank")),
            "updated_at": F.when(F.col("id").isin(1, 4), self.stamp(T1)).otherwise(self.stamp()),
        })

    @staticmethod
    def _number(column: str, start: int):
        return F.expr(f"cast(substring({column}, {start}) as bigint)")
