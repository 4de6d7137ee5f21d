"""The whole batch run into a fresh lake: first load, delta, repetition, interruption."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orderloom.config import Endpoint, Lake
from orderloom.operators import clean, facts
from orderloom.functions import date_parts
from orderloom.plans import batch
from orderloom.plans.batch import QualityError, Run, run_batch
from orderloom.schemas import SOURCE_TABLES
from orderloom.session import Scratch
from orderloom.sources import append_partitioned, read_layer, read_since, read_versioned, seen_keys, write_versioned
from orderloom.sources.files import list_dirs
from orderloom.streaming.suggestions import ACCEPTED_TOPIC, load_suggestions

T0, T1 = "2024-01-01 00:00:00", "2024-03-01 00:00:00"


class World:
    """Source tables as parquet, a topic as folders, and the lake between."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        self.lake = Lake(
            f"{self.root}/lake",
            Endpoint("parquet", path=f"{self.root}/source"),
            Endpoint("text", path=f"{self.root}/topics"),
        )
        self.deliveries = 0

    def put(self, table, values, mode="overwrite"):
        columns = [c.split()[0].strip("`") for c in SOURCE_TABLES[table].split(", ")]
        df = self.spark.createDataFrame(values, ", ".join(f"`{c}` string" for c in columns))
        typed = df.selectExpr(*(f"cast(`{c.split()[0].strip('`')}` as {c.split()[1]}) `{c.split()[0].strip('`')}`"
                                for c in SOURCE_TABLES[table].split(", ")))
        typed.write.mode(mode).parquet(f"{self.root}/source/{table}")

    def deliver(self, *messages):
        self.deliveries += 1
        frame = self.spark.createDataFrame([(m,) for m in messages], "value string").coalesce(1)
        frame.write.text(f"{self.root}/topics/{ACCEPTED_TOPIC}/batch={self.deliveries}")

    def seed(self):
        self.put("stores", [("1", "S1", "A1", "D1", "C1\r", T0), ("2", "S2", "A2", "D2", "C2", T0)])
        self.put("payment_method", [("1", "cash", "null\r", T0), ("9", "bank transfer", "ACB\r", T0)])
        self.put("product_category", [("1", "Tea", T0)])
        self.put("products", [("P1", "Black", "1", "30000", T0), ("P2", "Brown", "1", "45000", T0)])
        self.put("customers", [("1", "Ann", "0", "diamond", None)])
        self.put("orders", [("a", "2024-01-02 10:00:00", "1", "1", "9", "1"),
                            ("b", "2024-01-03 10:00:00", None, "2", "1", "2")])
        self.put("order_details", [("a", "P1", "1", "0", "30000", "false"), ("b", "P1", "2", "0", "60000", "false"),
                                   ("b", "P2", "1", "0", "45000", "false")])
        self.deliver(
            '{"order_id":"a","product_id":"P2","quantity":1,"discount_percent":20,"subtotal":36000,"is_suggestion":true}',
            "{broken",
        )

    def delta(self):
        self.put("products", [("P1", "Black", "1", "32000", T1), ("P3", "White", "1", "50000", T1)], "append")
        self.put("stores", [("3", "S3", "A3", "D3", "C3", T1)], "append")
        self.put("orders", [("c", "2024-01-03 12:00:00", "1", "3", "9", "1"),
                            ("d", "2024-01-05 08:00:00", "1", "1", "9", "1")], "append")
        self.put("order_details", [("c", "P3", "1", "0", "50000", "false"), ("d", "P2", "1", "0", "45000", "false")],
                 "append")
        again = '{"order_id":"a","product_id":"P2","quantity":1,"discount_percent":20,"subtotal":36000,"is_suggestion":true}'
        self.deliver(again, again.replace('"a"', '"d"').replace("P2", "P1"))

    def fact(self):
        return read_layer(self.spark, self.lake.gold("fact_orders"))

    def gold(self, name):
        return read_versioned(self.spark, self.lake.gold(name))


def shown(world):
    """The fact under business keys."""
    products = world.gold("dim_products").select("product_key", "product_id", "unit_price")
    stores = world.gold("dim_stores").select("store_key", "store_id")
    return sorted(
        tuple(r) for r in world.fact().join(products, "product_key").join(stores, "store_key")
        .select("order_id", "product_id", "store_id", "quantity", "subtotal", F.col("order_date").cast("string"))
        .collect()
    )


FIRST = [
    ("a", "P1", 1, 1, 30000, "2024-01-02 10:00:00"), ("a", "P2", 1, 1, 36000, "2024-01-02 10:00:00"),
    ("b", "P1", 2, 2, 60000, "2024-01-03 10:00:00"), ("b", "P2", 2, 1, 45000, "2024-01-03 10:00:00"),
]
SECOND = [
    ("c", "P3", 3, 1, 50000, "2024-01-03 12:00:00"), ("d", "P1", 1, 1, 36000, "2024-01-05 08:00:00"),
    ("d", "P2", 1, 1, 45000, "2024-01-05 08:00:00"),
]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """A world after its first run, with that run's reports."""
    made = World(spark, tmp_path_factory.mktemp("loaded"))
    made.seed()
    return made, run_batch(spark, made.lake, "2024-01-04")


def test_first_load(spark, loaded, rows):
    world, reports = loaded
    assert shown(world) == FIRST
    failed = rows(reports["bronze"].filter("NOT passed"), "table_name", "column_name")
    # customer b is missing (1 of 2), and the broken message has no fields at all
    assert ("orders", "customer_id") in failed
    assert ("order_suggestion_accepted", "order_id") in failed
    assert {r[0] for r in rows(reports["gold"], "table_name")} == {
        "gld.dim_payment_method", "gld.dim_stores", "gld.dim_products", "gld.fact_orders"
    }
    assert rows(world.gold("dim_payment_method"), "method_id", "bank") == [(1, None), (9, "ACB")]


def test_ingestion_days_do_not_go_back(spark, loaded):
    with pytest.raises(ValueError, match="before the suggestions"):
        run_batch(spark, loaded[0].lake, "2024-01-03")


def test_suggestions_do_not_come_in_before_their_orders(spark, tmp_path):
    world = World(spark, tmp_path)
    world.seed()
    with pytest.raises(ValueError, match="before the orders"):
        run_batch(spark, world.lake, "2024-01-01")


def test_delta_and_repetition(spark, loaded, rows):
    world, _ = loaded
    world.delta()
    run_batch(spark, world.lake, "2024-03-02")
    # c came later on a day that was loaded already; the suggestion for a was delivered twice
    assert shown(world) == sorted(FIRST + SECOND)
    versions = rows(world.gold("dim_products"), "product_key", "product_id", "unit_price", "is_current",
                    F.col("end_date").cast("string"))
    assert versions == [
        (0, "P1", 30000, False, "2024-03-02"), (1, "P2", 45000, True, None),
        (2, "P1", 32000, True, None), (3, "P3", 50000, True, None),
    ]
    assert rows(world.gold("dim_stores"), "store_key", "store_id") == [(0, 1), (1, 2), (2, 3)]

    # A single computation over the sources gives the same lines.
    silver = date_parts(clean.clean_orders(spark.read.parquet(f"{world.root}/source/orders")), "timestamp")
    lines = read_layer(spark, world.lake.silver("order_details"))
    whole = facts.build_fact(
        silver, lines, world.gold("dim_products"), world.gold("dim_stores"), world.gold("dim_payment_method")
    )
    measures = ("order_id", "quantity", "subtotal")
    assert rows(whole, *measures) == rows(world.fact(), *measures)

    # A table without any time is loaded once and not again.
    assert read_layer(spark, world.lake.bronze("customers")).count() == 1

    names = ("dim_products", "dim_stores", "dim_payment_method")
    before = shown(world), [rows(world.gold(n)) for n in names], rows(lines)
    run_batch(spark, world.lake, "2024-03-03")
    after = read_layer(spark, world.lake.silver("order_details"))
    assert (shown(world), [rows(world.gold(n)) for n in names], rows(after)) == before
    assert len(list_dirs(spark, world.lake.gold("dim_products"), "snapshot")) == 2


def test_schema_drift_is_kept_until_accepted(spark, loaded, rows):
    world, _ = loaded
    with Scratch(spark) as scratch:
        run = Run(spark, world.lake, scratch, "2024-03-03")
        assert run.check_schemas() == {}
        path = world.lake.bronze("stores")
        widened = scratch.stage(read_layer(spark, path).withColumn("phone", F.lit("1")), "widened")
        widened.write.mode("overwrite").partitionBy("year", "month", "day").parquet(path)
        drift = run.check_schemas()
        assert ("phone", "added") in rows(drift["stores"], "column_name", "change")
        assert "stores" in run.check_schemas()  # still reported
        run.check_schemas(accept=True)
        assert run.check_schemas() == {}


def test_interruption_ties_and_early_suggestions(spark, tmp_path, monkeypatch):
    world = World(spark, tmp_path)
    world.seed()
    run_batch(spark, world.lake, "2024-01-04")

    # A suggestion taken in before its order does not hide the order's own lines.
    world.deliver('{"order_id":"d","product_id":"P1","quantity":1,"discount_percent":20,"subtotal":36000,"is_suggestion":true}')
    world.put("orders", [("c", "2024-01-03 12:00:00", "1", "1", "9", "1")], "append")
    world.put("order_details", [("c", "P2", "1", "0", "45000", "false")], "append")
    run_batch(spark, world.lake, "2024-01-05")

    # Stopped between the lines and the orders of a layer, in both layers one after the other.
    world.put("orders", [("d", "2024-01-05 08:00:00", "1", "1", "9", "1")], "append")
    world.put("order_details", [("d", "P2", "1", "0", "45000", "false")], "append")
    for layer in (world.lake.bronze, world.lake.silver):

        def break_before_orders(df, path, broken=layer("orders")):
            if path == broken:
                raise RuntimeError("executor gone")
            append_partitioned(df, path)

        with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="executor gone"):
            patch.setattr(batch, "append_partitioned", break_before_orders)
            run_batch(spark, world.lake, "2024-01-05")
    # An order at the very instant of the watermark comes in only when asked for.
    run_batch(spark, world.lake, "2024-01-06")
    world.put("orders", [("e", "2024-01-05 08:00:00", "1", "1", "9", "1")], "append")
    world.put("order_details", [("e", "P1", "1", "0", "30000", "false")], "append")
    expected = sorted(FIRST + [
        ("c", "P2", 1, 1, 45000, "2024-01-03 12:00:00"),
        ("d", "P1", 1, 1, 36000, "2024-01-05 08:00:00"), ("d", "P2", 1, 1, 45000, "2024-01-05 08:00:00"),
    ])
    assert shown(world) == expected
    run_batch(spark, world.lake, "2024-01-06", ties="anti")
    assert shown(world) == [*expected, ("e", "P1", 1, 1, 30000, "2024-01-05 08:00:00")]

    with pytest.raises(QualityError, match="order_suggestion_accepted"):
        run_batch(spark, world.lake, "2024-01-06", fail_on_error=True)


OFFER = '{"order_id":"%s","product_id":"P2","quantity":1,"discount_percent":20,"subtotal":36000,"is_suggestion":true}'


def test_suggestions_are_read_from_the_news(spark, tmp_path):
    """A repeat is known however long ago its first delivery was, and neither that day nor buckets without news are read."""
    world = World(spark, tmp_path)
    world.seed()
    store = world.lake.keys("silver", "order_details", "suggestion")

    def step(day, *offers):
        world.put("orders", [(f"n{day}", f"2024-01-{day:02} 07:00:00", "1", "1", "9", "1")], "append")
        world.put("order_details", [(f"n{day}", "P1", "1", "0", "45000", "false")], "append")
        world.deliver(*(OFFER % name for name in offers))
        with Scratch(spark) as scratch:
            run = Run(spark, world.lake, scratch, f"2024-01-{day:02}")
            run.load_orders()
            load_suggestions(spark, world.lake, run.as_of)
            run.build_silver_facts()

    def spoil(folder):
        for file in Path(folder).rglob("*.parquet"):
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
            file.write_text("not to be read")

    def offers():
        lines = read_layer(spark, world.lake.silver("order_details")).filter("is_suggestion")
        return sorted((r.order_id, r.day) for r in lines.collect())

    step(4, *"abc")
    step(5, *"ad", "d")
    step(6, "e")
    assert offers() == [("a", 4), ("b", 4), ("c", 4), ("d", 5), ("e", 6)]
    assert seen_keys.newest(spark, store) == "2024-01-05"  # those of the 6th are taken in when next asked for

    def bucket_of(order):
        row = spark.createDataFrame([(order, "P2", True)], "order_id string, product_id string, is_suggestion boolean")
        return row.select(seen_keys._bucket().alias("b")).first().b

    asked = {bucket_of("a"), bucket_of("e"), bucket_of("f")}
    spoil(f"{world.lake.bronze(ACCEPTED_TOPIC)}/year=2024/month=1/day=4")
    for folder in Path(store).glob("delivered=20240104/bucket=*"):
        if int(folder.name.partition("=")[2]) not in asked:
            spoil(folder)
    step(7, "a", "e", "f")
    kept = read_since(spark, world.lake.silver("order_details"), "2024-01-06").filter("is_suggestion")
    assert sorted((r.order_id, r.day) for r in kept.collect()) == [("e", 6), ("f", 7)]


def test_a_lost_store_of_seen_suggestions_is_made_again(spark, tmp_path):
    dated = "order_id string, product_id string, is_suggestion boolean, year int, month int, day int"
    lines = spark.createDataFrame([("a", "P1", True, 2024, 1, 4), ("a", "P1", True, 2024, 1, 3), (None, None, None, 2024, 1, 5)], dated)
    given = spark.createDataFrame([("a", "P1", True, 2024, 1, 4), (None, None, None, 2024, 1, 5), ("b", "P1", True, 2024, 1, 5)], dated)
    store = str(tmp_path / "seen")
    assert seen_keys.newest(spark, store) is None
    for _ in range(2):  # the line of the 3rd is the order's own
        seen_keys.follow(spark, store, lines, given)
        assert sorted(r.delivered for r in spark.read.parquet(store).collect()) == [20240104, 20240105]
    assert [r.order_id for r in seen_keys.unseen(spark, store, given).collect()] == ["b"]


def test_failed_snapshots_do_not_count(spark, tmp_path):
    path = str(tmp_path / "table")
    write_versioned(spark.range(1), path)
    spark.range(9).write.parquet(f"{path}/snapshot=2")
    assert read_versioned(spark, path).count() == 1
    write_versioned(read_versioned(spark, path).union(spark.range(1)), path)  # reads what it replaces
    assert read_versioned(spark, path).count() == 2
    assert [n for n, _ in list_dirs(spark, path, "snapshot")] == [3, 1]


def test_other_table_formats(spark, tmp_path):
    """Where the session knows another versioned format it is used as it is; parquet stands in."""
    path = str(tmp_path / "table")
    write_versioned(spark.range(3), path, "parquet")
    assert read_versioned(spark, path, "parquet").count() == 3


def test_an_append_cut_short_is_settled(spark, tmp_path, monkeypatch):
    from orderloom.sources import layers

    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(i, 2024, 1, 1 + i % 3) for i in range(9)], "id int, year int, month int, day int")
    append_partitioned(rows.where("id < 3"), path)

    def broken(*_):
        raise RuntimeError("driver gone")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="driver gone"):
        patch.setattr(layers, "mark", broken)  # data written, not committed
        append_partitioned(rows.where("id >= 3"), path)
    assert read_layer(spark, path).count() == 3
    layers.settle(spark, path)
    assert read_layer(spark, path).count() == 3
    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="driver gone"):
        patch.setattr(layers, "settle", broken)  # committed, not moved in
        append_partitioned(rows.where("id >= 3"), path)
    moved = sorted((tmp_path / "table/_pending/data").rglob("part-*.parquet"))[0]
    place = tmp_path / "table" / moved.relative_to(tmp_path / "table/_pending/data")
    place.parent.mkdir(parents=True, exist_ok=True)
    moved.rename(place)  # part of it moved in
    with pytest.raises(RuntimeError, match="settle"):
        append_partitioned(rows, path)
    layers.settle(spark, path)
    layers.settle(spark, path)
    assert sorted(r.id for r in read_layer(spark, path).collect()) == list(range(9))


def test_snapshots_without_success_files(spark, tmp_path):
    path = str(tmp_path / "table")
    setting = spark._jsc.hadoopConfiguration()
    setting.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        for n in (1, 2, 3):
            write_versioned(spark.range(n), path)
            assert read_versioned(spark, path).count() == n
    finally:
        setting.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_steps_settle_what_they_read(spark, tmp_path, monkeypatch):
    """A load that dies while it moves day files in, then the next step by itself: no order is lost."""
    from orderloom.sources import layers

    world = World(spark, tmp_path)
    world.seed()
    move = layers.move_below

    def dies(spark_, source, target):
        if target == world.lake.bronze("orders"):
            move(spark_, f"{source}/year=2024/month=1/day=3", f"{target}/year=2024/month=1/day=3")
            raise RuntimeError("driver gone")
        move(spark_, source, target)

    def step(work):
        with Scratch(spark) as scratch:
            work(Run(spark, world.lake, scratch, "2024-01-04"))

    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="driver gone"):
        patch.setattr(layers, "move_below", dies)
        step(Run.load_bronze)
    step(Run.build_silver_facts)
    step(Run.load_bronze)
    step(Run.build_silver_facts)
    assert sorted(r.order_id for r in read_layer(spark, world.lake.silver("orders")).collect()) == ["a", "b"]
    assert read_layer(spark, world.lake.bronze("orders")).count() == 2


def dimension_rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(scd2_columns(df)).collect()))


def scd2_columns(df):
    return sorted(df.columns)


def test_merge_touches_only_what_changed(spark, tmp_path, monkeypatch):
    """Same rows as a rewrite; closed history and buckets without changes keep their files; a cut is settled."""
    from orderloom.config import PRODUCTS
    from orderloom.operators import scd2
    from orderloom.sources import layers

    path = f"{tmp_path}/dim"
    columns = "product_id string, product_name string, category string, unit_price int, updated_at timestamp_ntz"

    def source(prices, at):
        rows = [(f"P{i}", f"N{i}", "Tea", p, None) for i, p in prices.items()]
        return spark.createDataFrame(rows, columns).withColumn("updated_at", F.lit(at).cast("timestamp_ntz"))

    def files():
        return {str(f.relative_to(path)) for f in (tmp_path / "dim").rglob("*.parquet")}

    write_versioned(scd2.initial_load(source({i: 100 for i in range(60)}, T0), PRODUCTS), path, "merged", key="product_id")
    rewritten = scd2.initial_load(source({i: 100 for i in range(60)}, T0), PRODUCTS)
    for day, changed in (("2024-03-01", {3: 150, 70: 5}), ("2024-03-02", {3: 160, 4: 1})):
        new = source({**{i: 100 for i in range(60)}, 70: 5, **changed}, T1)
        rewritten = scd2.apply(rewritten, new, PRODUCTS, day)
        before = files()
        rows = scd2.merge(layers.read_merged(spark, path, current=True), layers.read_merged(spark, path), new, PRODUCTS, day)
        with monkeypatch.context() as patch, pytest.raises(RuntimeError):
            patch.setattr(layers, "_replace_partitions", lambda *_: (_ for _ in ()).throw(RuntimeError("gone")))
            layers.merge_versions(spark, path, rows, "product_id")
        layers.settle(spark, path)
        after = files()
        assert dimension_rows(read_versioned(spark, path, "merged")) == dimension_rows(rewritten)
        touched = {f"v_bucket={r[0]}" for r in spark.createDataFrame([(f"P{i}",) for i in changed], "k string")
                   .select(layers.bucket_of("k")).collect()}
        gone = before - after
        assert gone and all("v_state=current" in f and any(f"{t}/" in f for t in touched) for f in gone)
        assert {f for f in before if "v_state=closed" in f} <= after


def test_runs_on_merged_dimensions(spark, tmp_path):
    world = World(spark, tmp_path)
    world.lake = Lake(world.lake.root, world.lake.source, world.lake.topics, "merged")
    world.seed()
    run_batch(spark, world.lake, "2024-01-04")
    world.gold = lambda name: read_versioned(spark, world.lake.gold(name), "merged").filter("is_current")
    assert shown(world) == FIRST
    world.delta()
    for _ in range(2):
        run_batch(spark, world.lake, "2024-03-02")
    products = read_versioned(spark, world.lake.gold("dim_products"), "merged")
    assert sorted((r.product_id, r.is_current) for r in products.collect()) == [
        ("P1", False), ("P1", True), ("P2", True), ("P3", True)]
    assert world.fact().count() == len(FIRST) + len(SECOND)


def test_lines_are_matched_once_for_the_store_of_suggestions(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    columns = "order_id string, product_id string, is_suggestion boolean, year int, month int, day int"
    suggestions = spark.createDataFrame([(f"o{i}", "P1", True, 2024, 1, 2) for i in range(6)], columns)
    lines = suggestions.mapInPandas(counted, columns)
    store = str(tmp_path / "store")
    seen_keys.follow(spark, store, lines, suggestions)
    assert read.value == 6
    assert seen_keys.newest(spark, store) == "2024-01-02"
    assert seen_keys.unseen(spark, store, suggestions).count() == 0
    seen_keys.follow(spark, store, lines.filter("false"), suggestions)  # no news: the store stays as it is
    assert spark.read.parquet(store).count() == 6
