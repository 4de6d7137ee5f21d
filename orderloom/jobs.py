"""Command line for spark-submit: one batch step, the whole batch run, a seed file, or the suggestion stream.

    spark-submit orderloom/jobs.py batch --config lake.json --as-of 2024-01-31
    spark-submit orderloom/jobs.py batch --config lake.json --step check-silver
    spark-submit orderloom/jobs.py seed --config lake.json --table products --file products.csv
    spark-submit orderloom/jobs.py stream --config lake.json --prefix shop.

The configuration is a JSON document with ``root``, ``source``, ``topics`` and, if wanted,
``table_format`` and ``settings``. Give secrets in Spark's own settings, not in this file.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from orderloom.config import DIMENSIONS, Endpoint, Lake
from orderloom.plans.batch import Run, run_batch
from orderloom.session import Scratch, build_session
from orderloom.sources import read_table
from orderloom.streaming.suggestions import PinnedReferences, publish, ready_from_changes, references, source_state

STEPS: dict[str, Callable[[Run], object]] = {
    "load-bronze": Run.load_bronze,
    "check-bronze": lambda run: _show(run.check_bronze().filter("NOT passed"), *run.check_schemas().values()),
    "accept-schemas": lambda run: run.check_schemas(accept=True),
    "silver-dimensions": Run.build_silver_dimensions,
    "silver-facts": Run.build_silver_facts,
    "check-silver": lambda run: _show(run.check_silver().filter("NOT passed")),
    "gold-dimensions": lambda run: [run.build_dimension(dim) for dim in DIMENSIONS],
    "gold-fact": Run.build_fact,
    "inspect": lambda run: _show(run.inspect(), run.preview()),
}


def _show(*reports: DataFrame) -> None:
    for report in reports:
        report.show(report.count(), truncate=False)  # a row per rule or column


def lake_from(document: dict) -> Lake:
    return Lake(
        document["root"], Endpoint(**document["source"]), Endpoint(**document["topics"]),
        document.get("table_format", "snapshot"),
    )


def start_stream(spark: SparkSession, lake: Lake, prefix: str, once: bool):
    """Suggestions from the change feeds; customers, methods and products come from the source tables, which are read
    again when they have changed."""
    tables = ("customers", "payment_method", "products")
    load = PinnedReferences(
        spark, lambda: references(*(read_table(spark, lake.source, t) for t in tables)),
        lambda: source_state(spark, lake.source, tables),
    )
    writer = publish(
        ready_from_changes(spark, lake.topics, prefix), load, lake.topics, lake.progress("order_suggestion")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("job", choices=["batch", "seed", "stream"])
    parser.add_argument("--config", required=True, help="JSON document of the lake")
    parser.add_argument("--step", choices=list(STEPS), help="only this step of the batch run")
    parser.add_argument("--as-of", default=date.today().isoformat(), help="business date, today if not given")
    parser.add_argument("--table", help="table of the seed file")
    parser.add_argument("--file", help="the seed file, or a folder of such")
    parser.add_argument("--ties", choices=["strict", "anti"], default="strict")
    parser.add_argument("--fail-on-error", action="store_true", help="stop at failed checks")
    parser.add_argument("--prefix", default="", help="what the change feed puts before its table names")
    parser.add_argument("--once", action="store_true", help="stop the stream when it has caught up")
    given = parser.parse_args(arguments)

    with open(given.config) as file:
        document = json.load(file)
    spark, lake = build_session("orderloom", document.get("settings")), lake_from(document)
    if given.job == "stream":
        start_stream(spark, lake, given.prefix, given.once).awaitTermination()
    elif given.job == "seed":
        with Scratch(spark) as scratch:
            Run(spark, lake, scratch, given.as_of, given.ties).load_seed(given.table, given.file)
    elif given.step:
        with Scratch(spark) as scratch:
            STEPS[given.step](Run(spark, lake, scratch, given.as_of, given.ties))
    else:
        _show(*run_batch(spark, lake, given.as_of, given.fail_on_error, given.ties).values())


if __name__ == "__main__":
    main()
