"""Small hand-made cases: edges the given tables do not have."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.config import PAYMENT_METHOD, STORES, Endpoint, Rule
from orderloom.functions import number_rows, strip_cr, text_or_null
from orderloom.plans.registry import QUERIES
from orderloom.session import stage
from orderloom.operators import clean, facts, incremental, ingest, quality, scd2, suggest
from orderloom.sources import countable, from_topic, key_store, layers, has_data, read_csv_dimension, read_table, read_topic, to_messages
from orderloom.sources.files import latest_watermark
from orderloom.sources.layers import append_partitioned, read_since
from orderloom.sources.relational import jdbc_options

T0, T1, T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"


def timed(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# Numbering

@pytest.mark.parametrize("rows", [0, 1, 3000])
@pytest.mark.parametrize("together", ["true", "false"])
def test_numbers_are_dense_and_ordered(spark, rows, together):
    df = spark.range(rows).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", together)
    try:
        got = number_rows(df, "k", "n", start=5).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.k for r in sorted(got, key=lambda r: r.n)] == sorted(f"k{i}" for i in range(rows))
    assert sorted(r.n for r in got) == list(range(5, 5 + rows))


# Text

def test_carriage_returns_and_null_text(spark, rows):
    df = spark.createDataFrame([("null",), ("null\r",), (None,), ("ACB\r",), ("x\ry",)], "bank string")
    assert rows(df.select(text_or_null("bank").alias("b")).filter("b IS NOT NULL")) == [("ACB",), ("x\ry",)]
    assert df.filter(strip_cr("bank") == "null").count() == 2


# Incremental loading

def orders(spark, *values):
    return timed(spark.createDataFrame(list(values), "id string, timestamp string"), "timestamp")


def test_watermark_keeps_fractions(spark):
    df = orders(spark, ("a", "2024-01-01 00:00:00.000001"), ("b", "2024-01-01 00:00:00"))
    lower = incremental.high_watermark(df, "timestamp")
    assert lower == "2024-01-01 00:00:00.000001"
    assert incremental.newer_than(df, "timestamp", lower).isEmpty()
    assert incremental.newer_than(df, "timestamp", "2024-01-01 00:00:00").count() == 1


def test_empty_target_and_upper_bound(spark, rows):
    df = orders(spark, ("a", T0), ("b", T1), ("c", T2), ("d", None))
    assert incremental.high_watermark(df.limit(0), "timestamp") is None
    assert incremental.newer_than(df, "timestamp", None).count() == 4
    assert rows(incremental.newer_than(df, "timestamp", T0, T1), "id") == [("b",)]


def test_ties(spark, rows):
    source = orders(spark, ("a", T0), ("b", T1), ("c", T1), ("d", T2))
    target = orders(spark, ("a", T0), ("b", T1))
    assert rows(incremental.newer_than(source, "timestamp", T1), "id") == [("d",)]
    caught = incremental.newer_than(source, "timestamp", T1, ties="anti", target=target, key="id")
    assert rows(caught, "id") == [("c",), ("d",)]


def test_latest_by_key(spark, rows):
    df = spark.createDataFrame([(1, "x", T0), (1, "y", T1), (1, "z", None), (2, None, T0), (None, "n", T0)],
                               "id int, v string, updated_at string")
    assert rows(incremental.latest_by_key(df, "id", "updated_at")) == [
        (1, "y", T1), (2, None, T0), (None, "n", T0)
    ]


def test_latest_by_key_reduces_before_the_shuffle(spark):
    df = spark.range(10).select(F.lit(1).alias("id"), F.col("id").alias("v"), F.col("id").alias("updated_at"))
    plan = incremental.latest_by_key(df, "id", "updated_at")._jdf.queryExecution().sparkPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_watermark_comes_from_the_newest_folder(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    assert latest_watermark(spark, path, "timestamp") is None and not has_data(spark, path)
    df = incremental.new_orders(orders(spark, ("a", T0), ("b", "2023-12-31 10:00:00"), ("c", T1), ("n", None)), None)
    append_partitioned(df, path)
    assert has_data(spark, path)
    assert latest_watermark(spark, path, "timestamp") == T1
    assert rows(read_since(spark, path, "2024-01-01"), "id") == [("a",), ("c",)]
    assert read_since(spark, path, "2025-01-01").isEmpty()
    assert read_since(spark, path, None).count() == 4


# Cleaning

def test_products_without_category_stay(spark, rows):
    products = spark.createDataFrame([("P1", "a", 1, 10, T0), ("P2", "b", 9, 20, T0), ("P1", "a2", 1, 11, T1)],
                                     "id string, name string, category_id int, unit_price int, updated_at string")
    categories = spark.createDataFrame([(1, "Tea", T0), (1, "Teas", T1)], "id int, name string, updated_at string")
    assert rows(clean.clean_products(products, categories)) == [("P1", "a2", "Teas", 11, T1), ("P2", "b", None, 20, T0)]


LINE = "order_id string, product_id string, quantity int, discount_percent int, subtotal int, is_suggestion boolean"


def test_suggestions_once(spark, rows):
    dated = LINE + ", year int, month int, day int"
    got = spark.createDataFrame([
        ("a", "P1", 1, 20, 5, True, 2024, 1, 2), ("a", "P1", 1, 20, 5, True, 2024, 1, 1),
        ("b", "P1", 1, 20, 5, True, 2024, 1, 1), (None, None, None, None, None, None, 2024, 1, 1),
        (None, None, None, None, None, None, 2024, 1, 2),
    ], dated)
    assert rows(clean.unseen_suggestions(got), "order_id", "day") == [("a", 1), ("b", 1), (None, 1)]
    seen = clean.unseen_suggestions(got)
    assert clean.unseen_suggestions(got, seen).isEmpty()
    assert rows(clean.unseen_suggestions(got, seen.filter("order_id = 'b'")), "order_id") == [("a",), (None,)]
    assert clean.unseen_suggestions(got, since="2024-01-02").isEmpty()


# Dimensions

def methods(spark, *values):
    return timed(spark.createDataFrame(list(values), "method_id int, method_name string, bank string, updated_at string"),
                 "updated_at")


def test_three_rounds_of_history(spark, rows):
    seen = ("method_key", "method_id", "bank", "is_current", "end_date")
    dim = scd2.initial_load(methods(spark, (1, "cash", None, T0), (2, "card", "X", T0), (3, "card", "Y", T0)),
                            PAYMENT_METHOD)
    assert rows(dim, *seen) == [(0, 1, None, True, None), (1, 2, "X", True, None), (2, 3, "Y", True, None)]

    # NULL to value, value to NULL, one new key, one key gone
    second = methods(spark, (1, "cash", "Z", T1), (2, "card", None, T1), (4, "card", "W", T1))
    assert scd2.has_updates(dim, second, PAYMENT_METHOD)
    dim = scd2.apply(dim, second, PAYMENT_METHOD, "2024-02-02")
    closed = date(2024, 2, 2)
    expected = [
        (0, 1, None, False, closed), (1, 2, "X", False, closed), (2, 3, "Y", True, None),
        (3, 1, "Z", True, None), (4, 2, None, True, None), (5, 4, "W", True, None),
    ]
    assert rows(dim, *seen) == expected

    # The same source again changes nothing, with and without the gate.
    assert not scd2.has_updates(dim, second, PAYMENT_METHOD)
    assert rows(scd2.apply(dim, second, PAYMENT_METHOD, "2024-03-03"), *seen) == expected

    # Back to an old value: a third version; two versions at once in the source: the newer counts.
    third = methods(spark, (1, "cash", None, T2), (1, "cash", "older", T1))
    dim = scd2.apply(dim, third, PAYMENT_METHOD, "2024-03-03")
    assert rows(dim.filter("method_id = 1"), *seen) == [
        (0, 1, None, False, closed), (3, 1, "Z", False, date(2024, 3, 3)), (6, 1, None, True, None),
    ]
    assert dim.filter("is_current").groupBy("method_id").count().filter("count > 1").isEmpty()
    assert dim.select("method_key").distinct().count() == dim.count()


def test_swapped_attributes_and_new_store(spark, rows):
    columns = "store_id int, store_name string, address string, district string, city string, updated_at string"
    first = timed(spark.createDataFrame([(1, "S", "A", None, "C", T0)], columns), "updated_at")
    second = timed(spark.createDataFrame([(1, "S", None, "A", "C", T1), (2, "N", "B", "D", "E", T1)], columns), "updated_at")
    found = scd2.changes(scd2.initial_load(first, STORES), second, STORES)
    assert rows(found, "store_id", "is_new") == [(1, False), (2, True)]


def test_first_version_into_empty_dimension(spark, rows):
    empty = scd2.initial_load(methods(spark, (1, "cash", None, T0)), PAYMENT_METHOD).filter("false")
    source = methods(spark, (7, "card", "X", T0))
    assert not scd2.has_updates(empty, source, PAYMENT_METHOD)  # nothing is newer than nothing
    assert rows(scd2.apply(empty, source, PAYMENT_METHOD, "2024-02-02"), "method_key", "method_id") == [(0, 7)]


# Fact

def test_day_watermark_skips_later_orders_of_the_day(spark, rows):
    df = orders(spark, ("early", "2024-01-01 10:00:00"), ("late", "2024-01-01 23:00:00"), ("next", "2024-01-02 00:00:00"))
    after = "2024-01-01 10:00:00"
    assert rows(facts.orders_after(df, after), "id") == [("late",), ("next",)]
    assert rows(facts.orders_after(df, after, "day"), "id") == [("next",)]
    assert facts.orders_after(df, None).count() == 3


# Quality

def check(df, *rules):
    return {(r.rule, r.column_name): (r.value, r.passed, r.message) for r in quality.check_table(df, "t", rules).collect()}


def test_null_ratio_at_and_above_the_limit(spark):
    rule = Rule("null_ratio", "v", 0.05)
    at = spark.range(40).select(F.when(F.col("id") >= 2, F.col("id")).alias("v"))
    assert check(at, rule)["null_ratio", "v"] == (2.0, True, "2 of 40 values are NULL")
    above = spark.range(39).select(F.when(F.col("id") >= 2, F.col("id")).alias("v"))
    assert check(above, rule)["null_ratio", "v"][1] is False


def test_keys_with_nulls(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "v int")
    found = check(df, Rule("repeated_keys", "v", 0), Rule("uniqueness", "v", 0))
    assert found["repeated_keys", "v"] == (1.0, False, "1 values occur more than once")
    assert found["uniqueness", "v"] == (2.0, False, "1 distinct of 3 rows")


def test_empty_table(spark):
    df = spark.createDataFrame([], "v int")
    found = check(df, Rule("null_ratio", "v", 0.05), Rule("completeness", "v", 1.0), Rule("minimum", "v", 0),
                  Rule("uniqueness", "v", 0))
    assert [found[k, "v"][1] for k in ("null_ratio", "completeness", "minimum", "uniqueness")] == [
        True, False, False, True
    ]


def test_minimum_and_completeness(spark):
    df = spark.createDataFrame([(-1,), (None,)], "v int")
    found = check(df, Rule("minimum", "v", 0), Rule("completeness", "v", 1.0))
    assert found["minimum", "v"] == (-1.0, False, "value below the minimum")
    assert found["completeness", "v"] == (0.5, False, "1 of 2 values are present")


def test_schema_drift_kinds(spark, rows):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c string")
    assert quality.schema_drift(df, df.schema, "t").isEmpty()
    old = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.LongType(), False)])
    assert not quality.same_schema(df.schema, old)
    assert rows(quality.schema_drift(df, old, "t"), "column_name", "change", "values_present") == [
        ("a", "moved", 1), ("a", "retyped", 1), ("b", "moved", 1), ("c", "added", 0)
    ]


def test_inspection(spark, tmp_path, rows):
    found = quality.inspect_tables(spark, {
        "here": lambda: spark.range(7), "gone": lambda: spark.read.parquet(str(tmp_path / "gone")),
    })
    assert rows(found) == [("gone", None, None, None, "cannot read: AnalysisException"), ("here", 7, 1, "id bigint", None)]


def test_preview_of_tables_of_any_columns(spark):
    tables = {"a": spark.range(7), "b": spark.createDataFrame([("x", None)], "name string, at date"), "c": spark.range(0)}
    found = quality.preview(tables, rows=2, order={"a": ["id"]})
    assert [tuple(r) for r in found.select("table_name", F.to_json("fields")).collect()] == [
        ("a", '{"id":0}'), ("a", '{"id":1}'), ("b", '{"at":null,"name":"x"}')]


def test_counts_come_from_file_footers(spark, tmp_path):
    """No rows are read for NULLs and minima, whatever the folders, and the results are those of a scan."""
    path = str(tmp_path / "t")
    rows = spark.range(100).selectExpr(
        "id", "cast(if(id % 3 = 0, null, id) as int) n", "if(id < 4, null, string(id)) s", "id % 2 as day")
    rows.write.partitionBy("day").parquet(path)
    rules = [Rule("null_ratio", "n", 0.05), Rule("completeness", "s", 1.0), Rule("minimum", "n", 0), Rule("uniqueness", "id", 0)]
    plain = quality.check_table(spark.read.parquet(path), "t", rules)
    found = quality.check_table(spark.read.parquet(path), "t", rules, counted=countable(spark, path))
    assert found.collect() == plain.collect()
    counted = quality.check_table(spark.read.parquet(path), "t", rules[:3], counted=countable(spark, path))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(n), COUNT(s), MIN(n)]" in plan and "FileScan" not in plan


def test_keys_are_counted_as_they_come(spark, tmp_path, monkeypatch):
    """Any split of rows into appends gives the numbers of one pass; each time only the new files are read."""
    table, store, keys, read = str(tmp_path / "t"), str(tmp_path / "store"), [], []

    def watched(df, label):
        if label == "keys":
            read.append(df.inputFiles())
        return stage(df, label)

    batches = [["a", "b", None], ["b", "c", "d", "d"], [], ["a", "b", None, "e"], ["f"] * 50 + ["g"], ["\u00e9", "", " "]]
    for number, batch in enumerate(batches):
        keys += batch
        before = {f for files in read for f in files}
        rows = spark.createDataFrame([(k, 2024, 1, 1 + number // 2) for k in batch], "id string, year int, month int, day int")
        append_partitioned(rows, table)
        for _ in range(2):  # the second time finds no news
            key_store.take_in(spark, store, table, "id", watched, slots=1)
        assert not batch or (read[-1] and not before & set(read[-1]))
        found = tuple(key_store.measured(spark, store).first())
        counts = {k: keys.count(k) for k in keys}
        assert found == (len(keys), len(set(keys) - {None}), sum(n > 1 for n in counts.values()))
    assert len(read) == sum(bool(b) for b in batches)
    with pytest.raises(ValueError, match="slots"):
        append_partitioned(spark.createDataFrame([("z", 2024, 1, 9)], "id string, year int, month int, day int"), table)
        key_store.take_in(spark, store, table, "id", stage, slots=2)

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as patch:  # committed, but not moved in
        patch.setattr(layers, "move_below", dies)
        with pytest.raises(OSError):
            key_store.take_in(spark, store, table, "id", stage, slots=1)
    key_store.take_in(spark, store, table, "id", stage, slots=1)
    assert key_store.measured(spark, store).first().rows == len(keys) + 1


def test_sketch_lets_every_old_key_through(spark):
    """The bit of every value is found again, and at low load hardly any other."""
    def placed(rows):
        place = F.pmod(F.xxhash64("id"), F.lit(4 * key_store.BITS))
        return rows.select(F.floor(place / key_store.BITS).alias("slot"), F.pmod(place, F.lit(key_store.BITS)).alias("bit"))

    sketch = placed(spark.range(2000)).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def found(rows):
        return placed(rows).join(sketch, "slot").filter(key_store._bit("bits", "bit")).count()

    assert found(spark.range(2000)) == 2000
    assert found(spark.range(10_000, 12_000)) < 100


# Messages and files

def test_broken_and_mistyped_messages(spark, rows):
    records = spark.createDataFrame([
        ('{"order_id":"a","product_id":"P1","quantity":"one","discount_percent":20,"subtotal":5,"is_suggestion":true}',),
        ("{nothing",),
    ], "value string")
    assert rows(ingest.accepted_suggestions(records, "2024-05-06")) == [
        ("a", "P1", None, 20, 5, True, 2024, 5, 6), (None, None, None, None, None, None, 2024, 5, 6)
    ]


def test_message_round_trip(spark, tmp_path, rows):
    from orderloom.sources import write_topic

    topics = Endpoint("text", path=str(tmp_path))
    df = spark.createDataFrame([("a", 1, True)], "order_id string, n int, f boolean")
    write_topic(df, topics, "t", "order_id", batch=1)
    write_topic(df, topics, "t", "order_id", batch=1)  # a second try replaces the first
    write_topic(df, topics, "t", "order_id", batch=2)
    back = from_topic(read_topic(spark, topics, "t"), "order_id string, n int, f boolean")
    assert rows(back) == [("a", 1, True), ("a", 1, True)]
    assert rows(to_messages(df, "order_id")) == [("a", '{"order_id":"a","n":1,"f":true}')]


def test_csv_by_position(spark, tmp_path, rows):
    (tmp_path / "p.csv").write_text('id,name,category,unit_price\nP1,"Tea, green",2,45000\nP2,Cake,5,40000\n')
    df = read_csv_dimension(spark, str(tmp_path / "p.csv"), "products", T0)
    assert rows(df, "id", "name", "category_id", "unit_price", F.col("updated_at").cast("string")) == [
        ("P1", "Tea, green", 2, 45000, T0), ("P2", "Cake", 5, 40000, T0)
    ]


def test_jdbc_options():
    source = Endpoint("jdbc", {"url": "jdbc:db:x"}, table_options={
        "orders": {"partitionColumn": "timestamp", "lowerBound": "a", "upperBound": "b", "numPartitions": "8"},
        "order_details": {"predicates": ["p0", "p1"], "since_query": "SELECT * FROM d WHERE at >= '{since}'"},
    })
    assert jdbc_options(source, "order_details", T0)["dbtable"] == f"(SELECT * FROM d WHERE at >= '{T0}') recent"
    assert jdbc_options(source, "orders")["numPartitions"] == "8"
    assert jdbc_options(source, "order_details") == {
        "preferTimestampNTZ": "true", "fetchsize": "10000", "url": "jdbc:db:x", "dbtable": "order_details"
    }


def test_file_source(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "orders"))
    assert read_table(spark, Endpoint("parquet", path=str(tmp_path)), "orders").count() == 3


# Suggestions

def ready(spark, *values):
    return spark.createDataFrame(
        list(values), "order_id string, customer_id string, payment_method_id string, product_ids array<string>"
    )


def test_eligibility(spark, rows):
    ids = spark.createDataFrame([(1,), (0,)], "id int")
    got = ready(spark, ("a", "1", "1", []), ("b", None, "1", []), ("c", "", "1", []), ("d", "1", None, []),
                ("e", "2", "1", []), ("f", "1", "2", []))
    assert rows(suggest.eligible_orders(got, ids, ids), "order_id") == [("a",)]
    numbers = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "order_id string, customer_id int, payment_method_id int")
    assert rows(suggest.eligible_orders(numbers, ids, ids), "order_id") == [("b",)]


def catalogue(spark, n):
    return spark.createDataFrame([(f"P{i}", f"name {i}", 1000 * i + 45000) for i in range(n)],
                                 "product_id string, product_name string, unit_price int")


def test_recommendation_against_brute_force(spark):
    """The moved number lands on the element a list of free products would give."""
    from hashlib import md5

    n = 9
    held = [[f"P{j}" for j in range(n) if (i >> j) & 1] + ["gone"] for i in range(0, 512, 5)]
    got = suggest.recommend(ready(spark, *((f"o{i}", "1", "1", h) for i, h in enumerate(held))), catalogue(spark, n))
    expected = {}
    for i, h in enumerate(held):
        free = sorted({f"P{j}" for j in range(n)} - set(h))
        digest = md5(f"o{i}".encode()).hexdigest()
        if free:
            product = free[int(digest[:7], 16) % len(free)]
            discount = 20 + int(digest[7:14], 16) % 31
            price = 1000 * int(product[1:]) + 45000
            expected[f"o{i}"] = (product, discount, price * (100 - discount) // 100)
    assert {r.order_id: (r.product_id, r.discount_percent, r.subtotal) for r in got.collect()} == expected


def test_no_suggestion_when_all_products_are_held(spark):
    got = suggest.recommend(ready(spark, ("a", "1", "1", ["P0", "P1"]), ("b", "1", "1", [])), catalogue(spark, 2))
    assert [r.order_id for r in got.collect()] == ["b"]


def test_assembly_counts_products_once(spark, rows):
    heads = spark.createDataFrame([("a", 1, 1, 2), ("b", 1, 1, 2), ("c", 1, 1, 0), ("d", 1, 1, 1), ("e", None, 1, 1)],
                                  "id string, customer_id int, payment_method_id int, num_products int")
    lines = spark.createDataFrame([("a", "P1"), ("a", "P2"), ("a", "P1"), ("b", "P1"), ("b", "P1"),
                                   ("d", "P1"), ("d", "P2"), ("e", "P1")], "order_id string, product_id string")
    assert rows(suggest.assemble_orders(heads, lines), "order_id", "customer_id", "product_ids") == [
        ("a", "1", ["P1", "P2"]), ("c", "1", []), ("e", None, ["P1"])
    ]


def test_numbering_deals_rows_by_range(spark):
    """No task sorts the whole: rows are written by range, and numbers come from counts of the ranges."""
    seen = []

    def watched(df, label):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label)

    df = spark.range(3000).select(F.col("id").alias("k"))
    plan = number_rows(df, "k", "n", stage=watched)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in seen[0] and "SinglePartition" not in seen[0] + plan and "Window" not in seen[0] + plan


@pytest.mark.parametrize("name", ["dim_products_initial", "dim_products_scd2", "rt_recommendations"])
def test_no_query_numbers_in_one_task(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan and "Window" not in plan
