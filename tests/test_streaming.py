"""The streaming side: file sources, run to their end, against scripts and a plain model."""

from __future__ import annotations

import json
import os
import random
from itertools import permutations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderloom.config import Endpoint, Lake
from orderloom.operators import suggest
from orderloom.sources import from_topic, read_layer, read_table, read_topic
from orderloom.streaming import assembly, changes, suggestions

EVENT = (
    "kind string, order_id string, customer_id string, payment_method_id string, num_products int, "
    "product_id string, event_time timestamp"
)
BASE = 1_704_067_200  # 2024-01-01


def order(name, at, number, customer="1"):
    return {"kind": "order", "order_id": name, "customer_id": customer, "payment_method_id": "9",
            "num_products": number, "at": at}


def line(name, at, product):
    return {"kind": "line", "order_id": name, "product_id": product, "at": at}


def write_steps(folder, steps):
    os.makedirs(folder)
    for i, events in enumerate(steps):
        file = f"{folder}/{i:03}.json"
        with open(file, "w") as out:
            for event in events:
                stamped = {k: v for k, v in event.items() if k != "at"}
                stamped["event_time"] = pd.Timestamp(BASE + event["at"], unit="s").isoformat() + "Z"
                out.write(json.dumps(stamped) + "\n")
        os.utime(file, (BASE + i, BASE + i))


def run(spark, root, steps, **settings):
    """Ready orders as (order, seconds from the base, customer, products); and the last progress."""
    folder = str(root / f"run{random.random()}")
    write_steps(f"{folder}/events", steps)
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(f"{folder}/events")
    query = (
        assembly.ready_orders(events, **settings).writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/out")
    )
    query.awaitTermination()
    ready = spark.read.schema(assembly.READY).parquet(f"{folder}/out")
    found = ready.select("order_id", F.unix_timestamp("ready_at") - BASE, "customer_id", "product_ids").collect()
    return sorted((r[0], r[1], r[2], tuple(r[3])) for r in found), query.recentProgress


SCRIPTS = {
    "order-first": [order("order-first", 0, 1), line("order-first", 10, "P1")],
    "line-first": [line("line-first", 0, "P1"), order("line-first", 10, 1)],
    "between": [line("between", 0, "P1"), order("between", 5, 2), line("between", 10, "P2")],
    "repeated-line": [order("repeated-line", 0, 2), line("repeated-line", 5, "P1"), line("repeated-line", 6, "P1")],
    "no-products": [order("no-products", 0, 0)],
    "too-many": [line("too-many", 0, "P1"), line("too-many", 1, "P2"), order("too-many", 2, 1)],
    "order-expired": [order("order-expired", 0, 1), line("order-expired", 130, "P1")],
    "line-expired": [line("line-expired", 0, "P1"), order("line-expired", 120, 1)],
    "no-customer": [order("no-customer", 0, 1, None), line("no-customer", 1, "P1")],
    "replayed": [order("replayed", 0, 1), line("replayed", 1, "P1"), order("replayed", 20, 1), line("replayed", 21, "P1")],
    "again-later": [order("again-later", 0, 1), line("again-later", 1, "P1"),
                    order("again-later", 150, 1), line("again-later", 151, "P1")],
    "lines-kept-alive": [line("lines-kept-alive", 0, "P1"), line("lines-kept-alive", 100, "P2"),
                         order("lines-kept-alive", 200, 2)],
    "order-kept-alive": [order("order-kept-alive", 0, 1), order("order-kept-alive", 100, 1),
                         line("order-kept-alive", 200, "P1")],
    "far-apart": [order("far-apart", 100, 1), line("far-apart", 300, "P1")],
    "first-expired": [line("first-expired", 100, "A"), line("first-expired", 300, "B"), order("first-expired", 310, 2)],
    "line-last": [order("line-last", 100, 1), line("line-last", 150, "P1"), order("line-last", 255, 1), line("line-last", 256, "P1")],
}
CLOCK = [order("clock", 50_000, 9)]  # moves the watermark past every horizon
EXPECTED = sorted([
    ("order-first", 10, "1", ("P1",)), ("line-first", 10, "1", ("P1",)), ("between", 10, "1", ("P1", "P2")),
    ("no-products", 0, "1", ()), ("no-customer", 1, None, ("P1",)), ("replayed", 1, "1", ("P1",)),
    ("again-later", 1, "1", ("P1",)), ("again-later", 151, "1", ("P1",)),
    ("lines-kept-alive", 200, "1", ("P1", "P2")), ("order-kept-alive", 200, "1", ("P1",)),
    ("line-last", 150, "1", ("P1",)), ("line-last", 256, "1", ("P1",)),
])


def test_scripts_event_by_event(spark, tmp_path):
    length = max(map(len, SCRIPTS.values()))
    steps = [[script[i] for script in SCRIPTS.values() if i < len(script)] for i in range(length)]
    steps.append(CLOCK)
    found, progress = run(spark, tmp_path, steps, lateness="600 seconds")
    assert found == EXPECTED
    left = [json.loads(p.json)["stateOperators"][0] for p in progress]
    assert left[-1]["numRowsTotal"] < left[-2]["numRowsTotal"]
    assert left[-1]["numRowsTotal"] <= 3  # only the clock's own state


def test_scripts_in_every_order_of_arrival(spark, tmp_path):
    """Each event of a script in its own micro-batch, in every order; and all together."""
    steps, expected = [[] for _ in range(max(map(len, SCRIPTS.values())))], []
    for script, events in SCRIPTS.items():
        for n, arrival in enumerate(permutations(events)):
            for step, event in zip(steps, arrival):
                step.append({**event, "order_id": f"{script} {n}"})
            expected += [(f"{script} {n}", *rest) for name, *rest in EXPECTED if name == script]
    for split in (steps, [sum(steps, [])]):
        found, _ = run(spark, tmp_path, [*split, CLOCK], lateness="600 seconds")
        assert found == sorted(expected)


def test_repeats_are_dropped_across_batches():
    events = pd.DataFrame({"kind": ["line"] * 3, "product_id": ["A", "A", None], "at": [1, 1, 2]})
    left = list(assembly.drop_repeats(iter([events, events, events.assign(at=3)])))
    assert [len(b) for b in left] == [2, 0, 2]


def model(events, horizon=120, dedup=100):
    """The rules in plain Python, one event instant at a time, without folding."""
    ready = []
    for name in {e["order_id"] for e in events}:
        info, info_until, products, lines_until, done = None, 0, set(), 0, -1
        own = [e for e in events if e["order_id"] == name]
        for at in sorted({e["at"] for e in own}):
            if at < done:
                continue
            if info and at >= info_until:
                info = None
            if at >= lines_until:
                products = set()
            for e in sorted(own, key=lambda e: e.get("num_products", 0)):
                if e["at"] == at and e["kind"] == "order":
                    info, info_until = e, at + horizon
                elif e["at"] == at:
                    products.add(e["product_id"])
                    lines_until = at + horizon
            if info and len(products) == info["num_products"]:
                ready.append((name, at, info["customer_id"], tuple(sorted(products))))
                info, products, done = None, set(), at + dedup
    return sorted(ready)


def random_events(seed, names):
    pick = random.Random(seed)
    events = []
    for i in range(names):
        name = f"o{i}"
        events.append(order(name, pick.randrange(0, 300), pick.randrange(0, 4)))
        for _ in range(pick.randrange(0, 9)):
            events.append(line(name, pick.randrange(0, 400), f"P{pick.randrange(0, 3)}"))
        if pick.random() < 0.3:
            events.append(order(name, pick.randrange(0, 400), pick.randrange(0, 4)))
    pick.shuffle(events)
    return events


def test_random_events_against_the_model(spark, tmp_path):
    scripted = [e for script in SCRIPTS.values() for e in script]
    events = random_events(5, 300) + scripted
    assert model(scripted) == EXPECTED
    # One hot order: thousands of repeats of its lines, complete at the end.
    events += [line("hot", i // 20, f"P{i % 3}") for i in range(6000)] + [order("hot", 310, 3)]
    found, _ = run(spark, tmp_path, [events[::2], events[1::2], CLOCK], lateness="600 seconds")
    assert found == model(events)


def test_orders_share_state_by_groups(spark, tmp_path, monkeypatch):
    """Calls to the state store follow the groups with events, not the orders."""
    monkeypatch.setattr(assembly, "GROUPS", 4)
    events = random_events(6, 200)
    found, progress = run(spark, tmp_path, [events[::2], events[1::2], CLOCK], lateness="600 seconds")
    assert found == model(events)
    kept = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert 4 <= max(kept) <= 4 * (3 + 2)  # a parcel per micro-batch, the progress, and a timer in two orders


def test_deletions_and_broken_records_are_skipped(spark, rows):
    def text(payload):
        return (json.dumps({"payload": payload}),)

    after = {"id": "a", "customer_id": 1, "payment_method_id": 9, "num_products": 1}
    records = spark.createDataFrame([
        text({"op": "c", "ts_ms": 1000, "after": after}), text({"op": "d", "ts_ms": 2000, "after": None}),
        text({"after": {**after, "id": "b", "customer_id": None}}), ("no json",),
        text({"op": "u", "ts_ms": 3000, "after": {**after, "num_products": 2}}),
    ], "value string")
    assert rows(changes.order_events(records), "order_id", "customer_id", "num_products") == [
        ("a", "1", 1), ("a", "1", 2), ("b", None, 1)
    ]


CUSTOMERS = [(1, "Ann", 0, "diamond", None), (2, "Bob", 0, "gold", None)]
METHODS = [(1, "cash", "null", None), (9, "bank transfer", "ACB\r", None)]
PRODUCTS = [(f"P{i}", f"name {i}", 1, 1000 * i, None) for i in range(1, 6)]


@pytest.fixture
def tables(spark):
    return (
        spark.createDataFrame(CUSTOMERS, "id int, name string, phone_number int, tier string, updated_at timestamp_ntz"),
        spark.createDataFrame(METHODS, "id int, method_name string, bank string, updated_at timestamp_ntz"),
        spark.createDataFrame(PRODUCTS, "id string, name string, category_id int, unit_price int, updated_at timestamp_ntz"),
    )


def feed(root, topics):
    def write(topic, file, rows, at=1):
        os.makedirs(f"{topics.path}/{topic}", exist_ok=True)
        with open(f"{topics.path}/{topic}/{file}.json", "w") as out:
            out.writelines(json.dumps({"payload": {"op": "c", "ts_ms": (BASE + at) * 1000, "after": r}}) + "\n" for r in rows)

    heads = [(f"o{i}", 1 + i % 2, 9 if i % 3 else 1, i % 4) for i in range(24)]
    write("db.orders", "a", [dict(zip(("id", "customer_id", "payment_method_id", "num_products"), h)) for h in heads])
    lines = [(h[0], f"P{p + 1}") for h in heads for p in range(h[3])]
    write("db.order_details", "a", [dict(zip(("order_id", "product_id"), x)) for x in lines])
    write("db.orders", "b", [{"id": "closing", "num_products": 1}], 5000)
    write("db.order_details", "b", [{"order_id": "closing", "product_id": "P1"}], 5000)
    return heads, lines


def test_from_changes_to_the_raw_layer(spark, tmp_path, tables, rows):
    """Both shapes of the flow, one query or two, give what the batch functions give."""
    expected = None
    for name in ("one", "two"):
        topics = Endpoint("text", path=str(tmp_path / name / "topics"))
        progress = str(tmp_path / name / "progress")
        heads, lines = feed(tmp_path, topics)
        ready = suggestions.ready_from_changes(spark, topics, prefix="db.")
        if name == "two":
            suggestions.announce(ready, topics, f"{progress}/ready").trigger(availableNow=True).start().awaitTermination()
            ready = suggestions.ready_from_topic(spark, topics)
        loads = []

        def load():
            loads.append(1)
            return suggestions.references(*tables)

        query = suggestions.publish(ready, load, topics, f"{progress}/publish").trigger(availableNow=True).start()
        query.awaitTermination()
        assert loads

        if expected is None:
            batch_orders = spark.createDataFrame(heads, "id string, customer_id int, payment_method_id int, num_products int")
            batch_lines = spark.createDataFrame(lines, "order_id string, product_id string")
            refs = suggestions.references(*tables)
            eligible = suggest.eligible_orders(suggest.assemble_orders(batch_orders, batch_lines), refs.customers, refs.methods)
            expected = suggest.recommend(eligible, refs.catalogue)
        offered = from_topic(read_topic(spark, topics, suggestions.SUGGESTION_TOPIC), suggestions_schema())
        assert rows(offered) == rows(expected) and not offered.isEmpty()

        lake = Lake(str(tmp_path / name / "lake"), topics, topics)
        for _ in range(2):  # the second run finds nothing new
            suggestions.load_suggestions(spark, lake, "2024-01-02")
        raw = read_layer(spark, lake.bronze("order_suggestion_accepted"))
        assert rows(raw.drop("year", "month", "day")) == rows(suggest.accepted(expected))


def test_references_are_pinned_until_their_tables_change(spark, tmp_path, tables, monkeypatch):
    source = Endpoint("parquet", path=str(tmp_path))
    names, numbered = ("customers", "payment_method", "products"), []
    plain = suggest.numbered_catalogue

    def counted(catalogue):
        numbered.append(catalogue)
        return plain(catalogue)

    monkeypatch.setattr(suggest, "numbered_catalogue", counted)
    for name, rows in zip(names, tables):
        rows.write.parquet(f"{tmp_path}/{name}")
    load = suggestions.PinnedReferences(
        spark, lambda: suggestions.references(*(read_table(spark, source, n) for n in names)), lambda: suggestions.source_state(spark, source, names))
    first = load()
    held = first.catalogue.collect()
    eligible = spark.createDataFrame(
        [(str(n), "1", "9", [held[n % len(held)].product_id]) for n in range(20)],
        "order_id string, customer_id string, payment_method_id string, product_ids array<string>")
    before = sorted(suggest.recommend(eligible, first.catalogue, first.size).collect())
    assert load() is first and len(numbered) == 1
    tables[2].limit(1).selectExpr("'PX' as id", "name", "category_id", "unit_price", "updated_at").write.mode("append").parquet(f"{tmp_path}/products")
    # the pinned rows stay as they are while they are in use
    assert sorted(suggest.recommend(eligible, first.catalogue, first.size).collect()) == before
    second = load()
    assert load() is second and len(numbered) == 2 and second.size == first.size + 1
    assert [r.number for r in second.catalogue.orderBy("product_id").collect()] == list(range(second.size))
    again = suggest.recommend(eligible, suggest.product_catalogue(read_table(spark, source, "products")))
    assert sorted(suggest.recommend(eligible, second.catalogue, second.size).collect()) == sorted(again.collect())


def suggestions_schema():
    from orderloom.schemas import SUGGESTION

    return SUGGESTION


def test_a_lagging_feed_loses_nothing(spark, tmp_path):
    """The order feed runs 500 seconds ahead of the line feed; the late line still completes."""
    def step(topic, number, at, after):
        os.makedirs(f"{tmp_path}/{topic}", exist_ok=True)
        file = f"{tmp_path}/{topic}/{number}.json"
        with open(file, "w") as out:
            out.write(json.dumps({"payload": {"op": "c", "ts_ms": (BASE + at) * 1000, "after": after}}) + "\n")
        os.utime(file, (BASE + number, BASE + number))

    for number, (name, at) in enumerate([("o1", 0), ("x", 500), ("y", 501), ("end", 5000)]):
        step("orders", number, at, {"id": name, "customer_id": 1, "payment_method_id": 9, "num_products": 1})
    for number, (name, at) in enumerate([("z", 0), ("z", 1), ("o1", 10), ("end", 5000)]):
        step("order_details", number, at, {"order_id": name, "product_id": "P1"})
    topics = Endpoint("text", path=str(tmp_path))
    query = (
        suggestions.ready_from_changes(spark, topics, maxFilesPerTrigger=1).writeStream.format("memory")
        .queryName("lagging").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [r.order_id for r in spark.table("lagging").collect()] == ["o1"]


def test_ready_orders_announced_twice_count_once(spark, tmp_path, rows):
    topics = Endpoint("text", path=str(tmp_path))
    os.makedirs(f"{tmp_path}/order_ready_for_checking")
    message = {"order_id": "a", "customer_id": "1", "payment_method_id": "9", "product_ids": ["P1"]}
    for file in ("a", "b"):
        with open(f"{tmp_path}/order_ready_for_checking/{file}.json", "w") as out:
            out.write((json.dumps({**message, "ready_at": "2024-01-01T00:00:00Z"}) + "\n") * 2)
    query = (
        suggestions.ready_from_topic(spark, topics, maxFilesPerTrigger=1).writeStream.format("memory").queryName("once")
        .option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows(spark.table("once"), "order_id", "product_ids") == [("a", ["P1"])]
