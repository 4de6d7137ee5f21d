"""The command line, step by step, with the stream's offers reaching the fact."""

from __future__ import annotations

import json

from test_batch import World
from test_streaming import BASE

from orderloom.jobs import STEPS, main
from orderloom.operators import suggest
from orderloom.sources import read_layer


def test_stream_then_batch_steps(spark, tmp_path, capsys):
    world = World(spark, tmp_path)
    world.seed()
    config = tmp_path / "lake.json"
    config.write_text(json.dumps({
        "root": world.lake.root, "source": {"format": "parquet", "path": world.lake.source.path},
        "topics": {"format": "text", "path": world.lake.topics.path},
    }))

    # The change feed of the seeded orders: a is a diamond customer's, paid through the partner bank.
    for topic, rows in {
        "shop.orders": [{"id": "a", "customer_id": 1, "payment_method_id": 9, "num_products": 1},
                        {"id": "b", "customer_id": None, "payment_method_id": 1, "num_products": 2}],
        "shop.order_details": [{"order_id": "a", "product_id": "P1"}, {"order_id": "b", "product_id": "P1"}],
    }.items():
        folder = tmp_path / "topics" / topic
        folder.mkdir(parents=True)
        (folder / "0.json").write_text("".join(
            json.dumps({"payload": {"op": "c", "ts_ms": BASE * 1000, "after": r}}) + "\n" for r in rows
        ))
    main(["stream", "--config", str(config), "--prefix", "shop.", "--once"])

    for step in STEPS:
        main(["batch", "--config", str(config), "--step", step, "--as-of", "2024-01-04"])
    printed = capsys.readouterr().out
    assert "gld.fact_orders" in printed and "customer_id" in printed

    # The seeded topic held an offer of P2 for a; the stream offered the only free product, P2 again.
    lines = read_layer(spark, world.lake.silver("order_details"))
    offers = lines.filter("is_suggestion AND order_id = 'a'")
    assert [r.product_id for r in offers.collect()] == ["P2"]
    assert read_layer(spark, world.lake.gold("fact_orders")).count() == 4
    assert suggest.ACCEPTED_COLUMNS == [c for c in lines.columns if c not in ("year", "month", "day")]


def test_seed_files_are_loaded_once_and_bad_lines_kept_apart(spark, tmp_path):
    world = World(spark, tmp_path)
    world.seed()
    config, file = tmp_path / "lake.json", tmp_path / "products.csv"
    config.write_text(json.dumps({
        "root": world.lake.root, "source": {"format": "parquet", "path": world.lake.source.path},
        "topics": {"format": "text", "path": world.lake.topics.path},
    }))
    file.write_text('id,name,category,unit_price\nP1,Known,1,5\nP8,"Green, hot",1,20000\nP9,Cake,1\nP10,Pie,one,3\n\n')
    for _ in range(2):
        main(["seed", "--config", str(config), "--table", "products", "--file", str(file), "--as-of", "2024-02-01"])
    products = spark.read.parquet(f"{world.lake.source.path}/products")
    assert sorted((r.id, r.name, r.unit_price) for r in products.collect()) == [
        ("P1", "Black", 30000), ("P2", "Brown", 45000), ("P8", "Green, hot", 20000)]
    rejects = spark.read.parquet(world.lake.rejects("products"))
    assert {r.line for r in rejects.collect()} == {"P9,Cake,1", "P10,Pie,one,3"}
