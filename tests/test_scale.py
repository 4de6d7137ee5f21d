"""What the plans look like: pruned reads, work split over tasks, results whole under skew."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from orderloom.config import PAYMENT_METHOD, PRODUCTS, STORES
from orderloom.operators import clean, facts, incremental, scd2, suggest
from orderloom.plans.registry import QUERIES
from orderloom.sources.layers import append_partitioned, read_since

LINE = "order_id string, product_id string, quantity int, discount_percent int, subtotal int, is_suggestion boolean"


@pytest.fixture
def small_tasks(spark):
    """No broadcast, and partitions count as hot from a few kilobytes on."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def run_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hot(spark, tmp_path):
    """90,000 lines, a third of them of one order and, with others, of one product."""
    heads = spark.range(20_000).select(
        F.concat(F.lit("o"), F.col("id").cast("string")).alias("id"),
        F.timestamp_seconds(1_704_067_200 + F.col("id") % 100_000).cast("timestamp_ntz").alias("timestamp"),
        (F.col("id") % 7).cast("int").alias("customer_id"), (F.col("id") % 3).cast("int").alias("store_id"),
        F.lit(1).alias("payment_method_id"), F.lit(1).alias("num_products"),
    )
    n = F.col("id")
    lines = spark.range(0, 90_000, 1, 12).select(
        F.concat(F.lit("o"), F.when(n % 3 == 0, 0).otherwise(n % 20_000).cast("string")).alias("order_id"),
        F.concat(F.lit("P"), F.when(n % 3 != 1, 0).otherwise(n % 50).cast("string")).alias("product_id"),
        F.lit(1).alias("quantity"), F.lit(0).alias("discount_percent"), (n % 1000).cast("int").alias("subtotal"),
        F.lit(False).alias("is_suggestion"),
    )
    heads.write.parquet(f"{tmp_path}/heads")
    lines.write.parquet(f"{tmp_path}/lines")
    return spark.read.parquet(f"{tmp_path}/heads"), spark.read.parquet(f"{tmp_path}/lines")


def dimensions(spark):
    products = spark.range(50).select(
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("product_id"), F.lit("n").alias("product_name"),
        F.lit("c").alias("category"), F.lit(1).alias("unit_price"), F.lit("2024").alias("updated_at"),
    )
    stores = spark.range(3).select(
        F.col("id").cast("int").alias("store_id"), F.lit("s").alias("store_name"), F.lit("a").alias("address"),
        F.lit("d").alias("district"), F.lit("c").alias("city"), F.lit("2024").alias("updated_at"),
    )
    methods = spark.createDataFrame([(1, "cash", None, "2024")],
                                    "method_id int, method_name string, bank string, updated_at string")
    return (scd2.initial_load(products, PRODUCTS), scd2.initial_load(stores, STORES),
            scd2.initial_load(methods, PAYMENT_METHOD))


def test_hot_order_is_split_when_lines_meet_orders(spark, hot, small_tasks):
    heads, lines = hot
    joined = incremental.lines_of(incremental.new_orders(heads, None), lines)
    assert "skew=true" in run_plan(joined)
    assert joined.count() == 90_000


def test_hot_order_and_product_are_split_in_the_fact(spark, hot, small_tasks):
    heads, lines = hot
    orders = clean.clean_orders(incremental.new_orders(heads, None))
    fact = facts.build_fact(orders, lines, *dimensions(spark))
    assert run_plan(fact).count("skew=true") >= 2
    assert fact.agg(F.count("*"), F.sum("subtotal")).first() == lines.agg(F.count("*"), F.sum("subtotal")).first()


def test_hot_order_shrinks_before_it_is_gathered(spark, hot, small_tasks):
    heads, lines = hot
    found = suggest.assemble_orders(heads, lines)
    one = lines.groupBy("order_id").agg(F.countDistinct("product_id").alias("n")).filter("n = 1")
    assert found.count() == one.join(heads, one.order_id == heads.id).count()


def test_hot_day_is_written_by_several_tasks(spark, tmp_path, small_tasks):
    rows = spark.range(0, 200_000, 1, 8).select(
        F.md5(F.col("id").cast("string")).alias("v"), F.lit(2024).alias("year"), F.lit(1).alias("month"),
        F.when(F.col("id") % 10 == 0, 1).otherwise(2).alias("day"),
    )
    path = f"{tmp_path}/t"
    append_partitioned(rows, path)
    assert len(glob.glob(f"{path}/year=2024/month=1/day=2/*.parquet")) > 1
    assert spark.read.parquet(path).count() == 200_000
    plan = read_since(spark, path, "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "day=1" not in plan


def test_fact_reads_only_its_columns(spark):
    plan = QUERIES["fact_orders_full"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lineitem = next(p for p in plan.split("FileScan") if "lineitem.parquet" in p)
    assert "l_tax" not in lineitem and "l_shipdate" not in lineitem and "l_orderkey" in lineitem
    assert "p_brand" not in plan and "s_acctbal" not in plan


def test_watermark_reaches_the_scan(spark):
    df = QUERIES["silver_orders"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderdate" in plan and "LessThanOrEqual(o_orderdate" in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"rt_assembly_stream", "dq_report", "inspect_tables"}))
def test_no_pairing_and_no_python_in_batch_plans(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for word in ("NestedLoop", "Cartesian", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert word not in plan
