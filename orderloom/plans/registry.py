"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.config import BRONZE_RULES, PAYMENT_METHOD, PRODUCTS, SILVER_RULES, STORES, Endpoint, Lake, Rule
from orderloom.functions import date_parts
from orderloom.operators import clean, facts, incremental, ingest, quality, scd2, suggest
from orderloom.plans.batch import Run, run_batch
from orderloom.plans.driver_views import AS_OF, CUTOFF, T0, T1, DriverTables
from orderloom.session import Scratch, scratch_path, stage
from orderloom.sources import csv_rejects, key_store, layers, read_csv_dimension
from orderloom.streaming import assembly, changes
from orderloom.streaming.suggestions import ACCEPTED_TOPIC, load_suggestions

SCD2_DAY = "2024-02-01"


def _source(spark: SparkSession, folder: str) -> DriverTables:
    return DriverTables(spark, folder)


# Raw layer

def bronze_orders_full(spark, folder):
    return incremental.new_orders(_source(spark, folder).orders(), None)


def _loaded_orders(src: DriverTables) -> DataFrame:
    return date_parts(src.orders().filter(F.col("timestamp") < src.stamp(CUTOFF)), "timestamp")


def _new_orders(src: DriverTables) -> DataFrame:
    lower = incremental.high_watermark(_loaded_orders(src), "timestamp")
    upper = incremental.high_watermark(src.orders(), "timestamp")
    return incremental.new_orders(src.orders(), lower, upper)


def bronze_orders_incremental(spark, folder):
    return _new_orders(_source(spark, folder))


def bronze_orders_ties(spark, folder):
    """As above when the last instant is only half loaded: its missing orders come too."""
    src = _source(spark, folder)
    lower = incremental.high_watermark(_loaded_orders(src), "timestamp")
    loaded = _loaded_orders(src).filter(
        (F.col("timestamp") < F.lit(lower).cast("timestamp_ntz")) | (F.col("customer_id") % 2 == 0)
    )
    return incremental.new_orders(src.orders(), lower, ties="anti", target=loaded, key="id")


def bronze_details_incremental(spark, folder):
    src = _source(spark, folder)
    return incremental.lines_of(_new_orders(src), src.order_details())


def bronze_dim_incremental(spark, folder):
    src = _source(spark, folder)
    lower = incremental.high_watermark(src.products_v1(), "updated_at")
    return incremental.new_rows(src.products_v2(), lower)


def bronze_suggestions(spark, folder):
    records = _source(spark, folder).suggestion_records().select("value")
    return ingest.accepted_suggestions(records, AS_OF)


def ingest_csv_dim(spark, folder):
    src = _source(spark, folder)
    path = scratch_path(spark, "products-csv")
    seed = src.products().join(
        src.product_category().select(F.col("id").alias("category_id"), F.col("name").alias("kind")), "category_id"
    ).select("id", F.concat_ws(", ", "name", "kind").alias("name"), F.col("category_id").alias("category"), "unit_price")
    seed.write.option("header", True).csv(path)
    return read_csv_dimension(spark, path, "products", T0)


def ingest_csv_rejects(spark, folder):
    """Lines of a seed file that do not fit: some without a price, some whose price is no number."""
    src = _source(spark, folder)
    path = scratch_path(spark, "products-csv")
    number = F.col("category_id")
    price = F.when(number % 7 == 0, F.lit(",n/a")).when(number % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(","), F.col("unit_price").cast("string")))
    lines = src.products().select(F.concat("id", F.lit(',"'), "name", F.lit('",'), F.col("category_id").cast("string"), price).alias("value"))
    header = spark.createDataFrame([("id,name,category,unit_price",)], "value string")
    header.union(lines).coalesce(1).write.text(path)  # one file: each begins with a header
    return csv_rejects(spark, path, "products", T0).select("table_name", "line", "rejected_at")


# Conformed layer

def silver_stores(spark, folder):
    src = _source(spark, folder)
    return clean.clean_stores(src.stores_v1().unionByName(src.stores_v2()))


def silver_products(spark, folder):
    src = _source(spark, folder)
    return clean.clean_products(src.products_v1().unionByName(src.products_v2()), src.product_category())


def silver_payment_method(spark, folder):
    src = _source(spark, folder)
    both = src.payment_method_v1().unionByName(src.payment_method_v2())
    return clean.clean_payment_methods(date_parts(both, "updated_at"))


def silver_customers(spark, folder):
    return clean.clean_customers(_source(spark, folder).customers())


def silver_orders(spark, folder):
    return clean.clean_orders(_new_orders(_source(spark, folder)))


def _suggestions(src: DriverTables, loaded: bool) -> DataFrame:
    records = src.suggestion_records()
    if loaded:
        records = records.filter("event_type = 'purchase'")
    return ingest.accepted_suggestions(records.select("value"), AS_OF)


def _silver_lines(src: DriverTables) -> DataFrame:
    loaded = incremental.lines_of(_loaded_orders(src), src.order_details()).unionByName(_suggestions(src, True))
    bronze_lines = incremental.lines_of(incremental.new_orders(src.orders(), None), src.order_details())
    return clean.clean_lines(_new_orders(src), bronze_lines, _suggestions(src, False), loaded)


def silver_order_details(spark, folder):
    return _silver_lines(_source(spark, folder))


def silver_suggestions_unseen(spark, folder):
    src = _source(spark, folder)
    return clean.unseen_suggestions(_suggestions(src, False), _suggestions(src, True))


def silver_suggestions_delta(spark, folder):
    """Suggestions among the lines of three runs: some on a first day, all of them (the first ones again) on a second, and
    all again on a third, with new orders each time. The first delivery stands."""
    src, lake = _source(spark, folder), _lake(spark)
    orders = stage(src.orders(), "orders")  # each counts the lines of all orders
    parts = [orders.filter(F.col("customer_id") % 3 == rest) for rest in (0, 1, 2)]
    records = [src.suggestion_records().filter("event_type = 'purchase'"), src.suggestion_records(), src.suggestion_records()]
    dated = [rows.withColumn("timestamp", src.stamp(f"2001-0{n}-15 00:00:00")) for n, rows in enumerate(parts, 5)]
    _put(lake, order_details=src.order_details())
    for day, rows, delivered in zip(DELIVERY_DAYS, dated, records):
        _put(lake, orders=rows)
        _deliver(lake, delivered)
        with Scratch(spark) as scratch:
            run = Run(spark, lake, scratch, day)
            run.load_orders()
            load_suggestions(spark, lake, day)
            run.build_silver_facts()
    lines = layers.read_layer(spark, lake.silver("order_details"))
    return lines.filter("day <> 15")  # the orders' own lines lie under the days of the orders


DELIVERY_DAYS = ("2001-06-01", "2001-07-01", AS_OF)


# Serving layer

def _products(src, version=None):
    table = {None: src.products, 1: src.products_v1, 2: src.products_v2}[version]()
    return clean.clean_products(table, src.product_category())


def _stores(src, version=None):
    return clean.clean_stores({None: src.stores, 1: src.stores_v1, 2: src.stores_v2}[version]())


def _methods(src, version=None):
    table = {None: src.payment_method, 1: src.payment_method_v1, 2: src.payment_method_v2}[version]()
    return clean.clean_payment_methods(table)


def _shown(dimension: DataFrame) -> DataFrame:
    """With the end date as text, so that every engine prints it alike."""
    return dimension.withColumn("end_date", F.col("end_date").cast("string"))


def dim_payment_initial(spark, folder):
    return _shown(scd2.initial_load(_methods(_source(spark, folder)), PAYMENT_METHOD))


def dim_products_initial(spark, folder):
    return _shown(scd2.initial_load(_products(_source(spark, folder)), PRODUCTS))


def dim_stores_initial(spark, folder):
    return _shown(scd2.initial_load(_stores(_source(spark, folder)), STORES))


def dim_products_changes(spark, folder):
    src = _source(spark, folder)
    return scd2.changes(scd2.initial_load(_products(src, 1), PRODUCTS), _products(src, 2), PRODUCTS)


def dim_payment_scd2(spark, folder):
    src = _source(spark, folder)
    target = scd2.initial_load(_methods(src, 1), PAYMENT_METHOD)
    return _shown(scd2.apply(target, _methods(src, 2), PAYMENT_METHOD, SCD2_DAY))


def dim_products_scd2(spark, folder):
    src = _source(spark, folder)
    target = scd2.initial_load(_products(src, 1), PRODUCTS)
    return _shown(scd2.apply(target, _products(src, 2), PRODUCTS, SCD2_DAY))


def dim_stores_scd2(spark, folder):
    src = _source(spark, folder)
    target = scd2.initial_load(_stores(src, 1), STORES)
    return _shown(scd2.apply(target, _stores(src, 2), STORES, SCD2_DAY))


def dim_products_merge(spark, folder):
    """The second version merged into a written table, and the table read again."""
    src = _source(spark, folder)
    path = scratch_path(spark, "dim-products")
    layers.write_versioned(scd2.initial_load(_products(src, 1), PRODUCTS), path, "merged", key=PRODUCTS.key)
    current, versions = layers.read_merged(spark, path, current=True), layers.read_merged(spark, path)
    layers.merge_versions(spark, path, scd2.merge(current, versions, _products(src, 2), PRODUCTS, SCD2_DAY), PRODUCTS.key)
    return _shown(layers.read_versioned(spark, path, "merged"))


def _lake(spark: SparkSession) -> Lake:
    root = scratch_path(spark, "lake")
    return Lake(f"{root}/lake", Endpoint("parquet", path=f"{root}/source"), Endpoint("text", path=f"{root}/topics"), "merged")


def _put(lake: Lake, **tables: DataFrame) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{lake.source.path}/{name}")


def _deliver(lake: Lake, records: DataFrame) -> None:
    records.select("value").write.mode("append").text(f"{lake.topics.path}/{ACCEPTED_TOPIC}")


def _monthly(src: DriverTables) -> DataFrame:
    """All orders, those of a month within its first two days (an hour for a day), so that a run makes fewer folders."""
    hours = F.expr("make_interval(0, 0, 0, 0, day(timestamp) - 1)")
    return src.orders().withColumn("timestamp", F.date_trunc("month", "timestamp").cast("timestamp_ntz") + hours)


def run_fact_full(spark, folder):
    """The whole batch run over all source tables and the topic, and the fact it wrote."""
    src, lake = _source(spark, folder), _lake(spark)
    _put(lake, orders=_monthly(src), order_details=src.order_details(), products=src.products(), stores=src.stores(),
         product_category=src.product_category(), payment_method=src.payment_method(), customers=src.customers())
    _deliver(lake, src.suggestion_records())
    run_batch(spark, lake, AS_OF)
    return layers.read_layer(spark, lake.gold("fact_orders"))


def run_fact_delta(spark, folder):
    """Two runs: orders before the cut with some suggestions, then everything with changed products; a third finds no news."""
    src, lake = _source(spark, folder), _lake(spark)
    details, records = src.order_details(), src.suggestion_records()
    orders = stage(_monthly(src), "orders")
    old = orders.filter(F.col("timestamp") < src.stamp(CUTOFF))
    _put(lake, orders=old, order_details=details, products=src.products_v1(), stores=src.stores(),
         product_category=src.product_category(), payment_method=src.payment_method(), customers=src.customers())
    _deliver(lake, records.filter("event_type = 'purchase'"))
    run_batch(spark, lake, AS_OF)
    _put(lake, orders=orders, products=src.products_v2())
    _deliver(lake, records.filter("event_type <> 'purchase'"))
    for _ in range(2):
        run_batch(spark, lake, AS_OF)
    return layers.read_layer(spark, lake.gold("fact_orders"))


def _fact(src: DriverTables, orders: DataFrame) -> DataFrame:
    dated = date_parts(src.orders().withColumnRenamed("id", "order_id"), "timestamp") if orders is None else orders
    return facts.build_fact(
        dated, src.order_details(),
        scd2.initial_load(_products(src), PRODUCTS),
        scd2.initial_load(_stores(src), STORES),
        scd2.initial_load(_methods(src), PAYMENT_METHOD),
    )


def fact_orders_full(spark, folder):
    return _fact(_source(spark, folder), None)


def _fact_after(src: DriverTables, grain: str, loaded_until: str) -> DataFrame:
    all_orders = clean.clean_orders(date_parts(src.orders(), "timestamp"))
    loaded = _fact(src, all_orders.filter(F.col("timestamp") < src.stamp(loaded_until)))
    after = incremental.high_watermark(loaded, "order_date")
    return _fact(src, facts.orders_after(all_orders, after, grain))


def fact_orders_incremental(spark, folder):
    return _fact_after(_source(spark, folder), "timestamp", CUTOFF)


def fact_orders_day_watermark(spark, folder):
    """Orders moved to noon: later orders of a loaded day are left out, as days compare with times."""
    src = _source(spark, folder)
    hour = F.expr("make_interval(0, 0, 0, 0, customer_id % 24)")
    orders = src.orders().withColumn("timestamp", F.col("timestamp") + hour)
    dated = clean.clean_orders(date_parts(orders, "timestamp"))
    after = incremental.high_watermark(
        dated.filter(F.col("timestamp") < F.lit("2001-01-01 12:00:00").cast("timestamp_ntz")), "timestamp"
    )
    return _fact(src, facts.orders_after(dated, after, "day"))


# Quality

def _bronze_tables(src: DriverTables) -> dict[str, DataFrame]:
    """Raw tables with flaws: some orders without customer, products in two versions."""
    orders = src.orders().withColumn(
        "customer_id", F.when(F.col("customer_id") % 16 != 0, F.col("customer_id"))
    )
    return {
        "orders": orders,
        "order_details": src.order_details(),
        "order_suggestion_accepted": _suggestions(src, False),
        "products": src.products_v1().unionByName(_changed_or_new(src)),
        "product_category": src.product_category(),
        "stores": src.stores(),
    }


def _changed_or_new(src: DriverTables) -> DataFrame:
    """Products of the second version that changed or that the first one lacks."""
    first = src.products_v1().select("id", F.lit(True).alias("known"))
    rows = src.products_v2().join(first, "id", "left")
    return rows.filter((F.col("updated_at") == src.stamp(T1)) | F.col("known").isNull()).drop("known")


def _silver_tables(src: DriverTables) -> dict[str, DataFrame]:
    bronze = _bronze_tables(src)
    lines = incremental.lines_of(date_parts(bronze["orders"], "timestamp"), bronze["order_details"])
    return {
        "products": clean.clean_products(bronze["products"], bronze["product_category"]),
        "stores": clean.clean_stores(bronze["stores"]),
        "payment_method": clean.clean_payment_methods(src.payment_method()),
        "orders": clean.clean_orders(bronze["orders"]),
        "order_details": lines.unionByName(clean.unseen_suggestions(bronze["order_suggestion_accepted"])),
    }


def _only(rules, *kinds):
    picked = {t: [r for r in rs if r.kind in kinds] for t, rs in rules.items()}
    return {t: rs for t, rs in picked.items() if rs}


def dq_null_ratio(spark, folder):
    return quality.check_tables(_bronze_tables(_source(spark, folder)), _only(BRONZE_RULES, "null_ratio"))


def dq_duplicate_keys(spark, folder):
    return quality.check_tables(_bronze_tables(_source(spark, folder)), _only(BRONZE_RULES, "repeated_keys"))


def dq_completeness(spark, folder):
    return quality.check_tables(_silver_tables(_source(spark, folder)), _only(SILVER_RULES, "completeness"))


def dq_min(spark, folder):
    return quality.check_tables(_silver_tables(_source(spark, folder)), _only(SILVER_RULES, "minimum"))


def dq_uniqueness(spark, folder):
    return quality.check_tables(_silver_tables(_source(spark, folder)), _only(SILVER_RULES, "uniqueness"))


def dq_uniqueness_delta(spark, folder):
    """Key rules of orders from counts kept beside the table: first the loaded orders, then the new ones, then orders of every
    fourth customer once more, on a later day."""
    src, root = _source(spark, folder), scratch_path(spark, "keys")
    table, store = f"{root}/orders", f"{root}/store"
    rules = [Rule("repeated_keys", "id", 0), Rule("uniqueness", "id", 0)]
    again = _again(src).withColumns({c: F.lit(v) for c, v in zip(("year", "month", "day"), (2030, 1, 1))})
    for rows in (_loaded_orders(src), _new_orders(src), again):
        yearly = rows.withColumns({"month": F.lit(1), "day": F.lit(1)})  # fewer folders
        layers.append_partitioned(yearly, table)
        key_store.take_in(spark, store, table, "id", stage)
    return quality.check_table(spark.read.parquet(table), "orders", rules, measured={"id": key_store.measured(spark, store)})


def _again(src: DriverTables) -> DataFrame:
    return date_parts(src.orders().filter("customer_id % 4 = 0"), "timestamp")


def dq_report(spark, folder):
    src = _source(spark, folder)
    bronze = quality.check_tables(_bronze_tables(src), BRONZE_RULES)
    silver = quality.check_tables(_silver_tables(src), SILVER_RULES)
    layer = "concat({}, table_name)"
    return bronze.withColumn("table_name", F.expr(layer.format("'brz.'"))).unionByName(
        silver.withColumn("table_name", F.expr(layer.format("'slv.'")))
    )


def dq_schema_drift(spark, folder):
    """Line table against an older agreement: one column added, one gone, one retyped, two moved."""
    accepted = T.StructType([
        T.StructField("order_id", T.StringType()), T.StructField("product_id", T.StringType()),
        T.StructField("subtotal", T.LongType()), T.StructField("quantity", T.IntegerType()),
        T.StructField("coupon", T.StringType()), T.StructField("is_suggestion", T.BooleanType()),
    ])
    return quality.schema_drift(_source(spark, folder).order_details(), accepted, "brz.order_details")


def inspect_tables(spark, folder):
    """The serving layer, written and then counted by its file footers."""
    paths = _serving_layer(spark, folder)
    paths["gld.missing"] = f"{folder}/missing.parquet"
    return quality.inspect_tables(spark, {name: lambda p=path: layers.countable(spark, p) for name, path in paths.items()})


PREVIEW_ORDER = {
    "gld.dim_stores": ["store_key"], "gld.dim_products": ["product_key"], "gld.dim_payment_method": ["method_key"],
    "gld.fact_orders": ["order_id", "product_key", "quantity", "subtotal"],
}


def preview_tables(spark, folder):
    """The first five rows of every table of the serving layer, by key."""
    tables = {name: spark.read.parquet(path) for name, path in _serving_layer(spark, folder).items()}
    shown = quality.preview(tables, order=PREVIEW_ORDER)
    return shown.select("table_name", F.to_json("fields").alias("fields"))


def _serving_layer(spark: SparkSession, folder: str) -> dict[str, str]:
    """Dimensions and fact written as plain tables; their paths by name."""
    src, root = _source(spark, folder), scratch_path(spark, "gold")
    paths = {name: f"{root}/{name}" for name in PREVIEW_ORDER}
    for dim, rows in ((STORES, _stores(src)), (PRODUCTS, _products(src)), (PAYMENT_METHOD, _methods(src))):
        layers.overwrite(scd2.initial_load(rows, dim), paths[f"gld.{dim.name}"])
    dims = [spark.read.parquet(paths[f"gld.{dim.name}"]) for dim in (PRODUCTS, STORES, PAYMENT_METHOD)]
    orders = date_parts(src.orders().withColumnRenamed("id", "order_id"), "timestamp")
    layers.overwrite(facts.build_fact(orders, src.order_details(), *dims), paths["gld.fact_orders"])
    return paths


# Suggestions

def ref_diamond_customers(spark, folder):
    return suggest.diamond_customers(_source(spark, folder).customers())


def ref_acb_methods(spark, folder):
    return suggest.acb_methods(_source(spark, folder).payment_method())


def ref_products(spark, folder):
    return suggest.product_catalogue(_source(spark, folder).products())


def _change_records(src: DriverTables) -> tuple[DataFrame, DataFrame]:
    """Change-feed text for orders and lines. Methods 5 were deleted again: their rows are gone."""
    deleted = F.col("payment_method_id") == 5
    order_after = F.when(~deleted, F.struct("id", "customer_id", "payment_method_id", "num_products"))
    order_text = F.to_json(F.struct(F.struct(
        F.when(deleted, "d").otherwise("c").alias("op"), _moment("id").alias("ts_ms"), order_after.alias("after")
    ).alias("payload")))
    line_text = F.to_json(F.struct(F.struct(
        F.lit("c").alias("op"), _moment("order_id").alias("ts_ms"),
        F.struct("order_id", "product_id").alias("after"),
    ).alias("payload")))
    return src.orders().select(order_text.alias("value")), src.order_details().select(line_text.alias("value"))


def _moment(order: str):
    """A time within one minute from T0, the same for all events of an order."""
    return F.lit(1_704_067_200_000) + F.pmod(F.col(order).cast("bigint"), F.lit(60)) * 1000


def rt_cdc_flatten(spark, folder):
    orders, lines = _change_records(_source(spark, folder))
    events = changes.order_events(orders).unionByName(changes.line_events(lines))
    return events.select("kind", "order_id", "customer_id", "payment_method_id", "num_products", "product_id")


def _ready(src: DriverTables) -> DataFrame:
    return suggest.assemble_orders(src.orders(), src.order_details())


def _ready_shown(ready: DataFrame) -> DataFrame:
    return ready.withColumn("product_ids", F.array_join("product_ids", ","))


def rt_order_assembly(spark, folder):
    return _ready_shown(_ready(_source(spark, folder)))


def _eligible(src: DriverTables) -> DataFrame:
    return suggest.eligible_orders(
        _ready(src), suggest.diamond_customers(src.customers()), suggest.acb_methods(src.payment_method())
    )


def rt_eligible_orders(spark, folder):
    return _ready_shown(_eligible(_source(spark, folder)))


def rt_recommendations(spark, folder):
    src = _source(spark, folder)
    return suggest.recommend(_eligible(src), suggest.product_catalogue(src.products()))


def rt_suggestion_accepted(spark, folder):
    return suggest.accepted(rt_recommendations(spark, folder))


def _assembled(spark: SparkSession, folder: str, announced: DataFrame | None = None) -> DataFrame:
    """The streaming assembly over change-feed files of all given orders, run to its end.

    A closing record in each feed moves the watermarks past all of them.
    """
    path = scratch_path(spark, "assembly-stream")
    session = assembly.with_state_store(spark)
    for feed, closing, name in zip(_change_records(_source(spark, folder)), (CLOSING_ORDER, CLOSING_LINE), ("orders", "lines")):
        feed.union(spark.createDataFrame([(closing,)], "value string")).write.text(f"{path}/{name}")
    if announced is not None:
        announced.write.parquet(f"{path}/announced")
        announced = session.read.parquet(f"{path}/announced")
    order_feed = changes.order_events(session.readStream.text(f"{path}/orders"))
    line_feed = changes.line_events(session.readStream.text(f"{path}/lines"))
    query = (
        assembly.ready_orders(order_feed, line_feed, announced=announced).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start(f"{path}/ready")
    )
    query.awaitTermination()
    ready = spark.read.schema(assembly.READY).parquet(f"{path}/ready")
    return _ready_shown(ready.withColumn("ready_at", F.unix_seconds("ready_at")))


def rt_assembly_stream(spark, folder):
    """The streaming assembly of all given orders."""
    return _assembled(spark, folder)


def rt_assembly_resumed(spark, folder):
    """The same feeds read by a query without progress after one that announced the orders of odd customers: none comes
    again. Orders of methods 1 to 3 were announced so long ago (120 s) that they are forgotten."""
    orders = _source(spark, folder).orders().filter("customer_id % 2 = 1")
    ago = F.when(F.col("payment_method_id") <= 3, 120).otherwise(0)
    return _assembled(spark, folder, orders.select(
        F.col("id").alias("order_id"), F.timestamp_seconds(F.floor(_moment("id") / 1000) - ago).alias("ready_at")))


# An hour after the events.
CLOSING_ORDER = '{"payload": {"op": "c", "ts_ms": 1704070800000, "after": {"id": "closing", "num_products": 1}}}'
CLOSING_LINE = '{"payload": {"op": "c", "ts_ms": 1704070800000, "after": {"order_id": "closing", "product_id": "-"}}}'

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        fact_orders_full, fact_orders_incremental, fact_orders_day_watermark,
        bronze_orders_full, bronze_orders_incremental, bronze_orders_ties, bronze_details_incremental,
        bronze_dim_incremental, bronze_suggestions, ingest_csv_dim, ingest_csv_rejects,
        silver_stores, silver_products, silver_payment_method, silver_customers, silver_orders,
        silver_order_details, silver_suggestions_unseen, silver_suggestions_delta,
        dim_payment_initial, dim_products_initial, dim_stores_initial, dim_products_changes,
        dim_payment_scd2, dim_products_scd2, dim_stores_scd2, dim_products_merge, run_fact_full, run_fact_delta,
        dq_schema_drift, dq_null_ratio, dq_duplicate_keys, dq_completeness, dq_min, dq_uniqueness, dq_uniqueness_delta,
        dq_report, inspect_tables, preview_tables,
        ref_diamond_customers, ref_acb_methods, ref_products,
        rt_cdc_flatten, rt_order_assembly, rt_eligible_orders, rt_recommendations,
        rt_suggestion_accepted, rt_assembly_stream, rt_assembly_resumed,
    )
}
