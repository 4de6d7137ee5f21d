"""From ready orders to published suggestions, and from accepted suggestions to the raw layer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from orderloom.config import Endpoint, Lake
from orderloom.operators import ingest, suggest
from orderloom.schemas import DATE_PARTS
from orderloom.session import scratch_path, staged_at
from orderloom.sources.files import delete, has_data, newest_day, state_of
from orderloom.sources.topics import parsed, stream_topic, to_messages, write_topic
from orderloom.streaming import assembly, changes

# Topics of the change feed carry the table names, after whatever prefix the feed gives them.
ORDER_CHANGES = "orders"
LINE_CHANGES = "order_details"
# Topic names of the messages.
READY_TOPIC = "order_ready_for_checking"
SUGGESTION_TOPIC = "order_suggestion"
ACCEPTED_TOPIC = "order_suggestion_accepted"


class References(NamedTuple):
    """What a suggestion is decided by: admitted customers and methods, and the catalogue."""

    customers: DataFrame
    methods: DataFrame
    catalogue: DataFrame
    size: int | None = None  # of a catalogue that is numbered already


class PinnedReferences:
    """References that stay as they are, staged and numbered once, until their tables have changed.

    ``version`` tells the state of the tables, ``read`` reads them. All micro-batches between two states see
    the same rows, and a write while a micro-batch runs counts from the next one on. The state is asked before the
    tables are read: what is written in between is read again rather than missed. Older staged rows go
    when newer ones are in use.
    """

    def __init__(self, spark: SparkSession, read: Callable[[], References], version: Callable[[], object]):
        self.spark, self.read, self.version = spark, read, version
        self.root, self.taken = scratch_path(spark, "references"), 0
        self.state: object = None
        self.pinned: References | None = None

    def __call__(self) -> References:
        state = self.version()
        if self.pinned is None or state != self.state:
            self.pinned, self.state = self._pin(self.read()), state
        return self.pinned

    def _pin(self, refs: References) -> References:
        self.taken += 1
        frames = {"customers": refs.customers, "methods": refs.methods, "catalogue": suggest.numbered_catalogue(refs.catalogue)}
        staged = {name: staged_at(rows, f"{self.root}/{self.taken}/{name}") for name, rows in frames.items()}
        delete(self.spark, f"{self.root}/{self.taken - 1}")
        return References(**staged, size=staged["catalogue"].count())


def source_state(spark: SparkSession, source: Endpoint, tables: Iterable[str], seconds: int = 60) -> object:
    """State of source tables: of files, the files there are; of a database, which does not tell, the time in steps of
    ``seconds``, so that its tables are read that often."""
    if source.format == "jdbc":
        return int(time.time() // seconds)
    return tuple(state_of(spark, f"{source.path}/{table}") for table in tables)


def references(customers: DataFrame, methods: DataFrame, products: DataFrame) -> References:
    return References(
        suggest.diamond_customers(customers), suggest.acb_methods(methods), suggest.product_catalogue(products)
    )


def ready_from_changes(
    spark: SparkSession, topics: Endpoint, prefix: str = "", lateness: str = "120 seconds", **options
) -> DataFrame:
    """The change feeds of orders and lines, assembled."""
    orders = changes.order_events(stream_topic(spark, topics, prefix + ORDER_CHANGES, **options))
    lines = changes.line_events(stream_topic(spark, topics, prefix + LINE_CHANGES, **options))
    return assembly.ready_orders(orders, lines, lateness=lateness)


def ready_from_topic(spark: SparkSession, topics: Endpoint, lateness: str = "100 seconds", **options) -> DataFrame:
    """Ready orders announced by another query, each taken once within ``lateness``."""
    ready = parsed(stream_topic(spark, topics, READY_TOPIC, **options), assembly.READY).select("data.*")
    ready = ready.withColumn("ready_at", F.coalesce("ready_at", F.current_timestamp()))
    return ready.withWatermark("ready_at", lateness).dropDuplicatesWithinWatermark(["order_id"])


def announce(ready: DataFrame, topics: Endpoint, progress: str) -> DataStreamWriter:
    """Publish ready orders for other queries."""
    if topics.format == "kafka":
        return (
            to_messages(ready, "order_id").writeStream.format("kafka")
            .options(**topics.options, topic=READY_TOPIC).option("checkpointLocation", progress)
        )
    return (
        to_messages(ready).writeStream.format("text").option("path", f"{topics.path}/{READY_TOPIC}")
        .option("checkpointLocation", progress)
    )


def publish(
    ready: DataFrame, load: Callable[[], References], topics: Endpoint, progress: str
) -> DataStreamWriter:
    """Suggest a product for every eligible ready order, to both suggestion topics.

    ``load`` is called once per micro-batch with orders, so customers, methods and products added since
    the last one count; ``PinnedReferences`` reads them only when they have changed. The suggestions of a
    batch are kept while both topics are written.
    """

    def batch(orders: DataFrame, number: int) -> None:
        orders = orders.select("order_id", "customer_id", "payment_method_id", "product_ids").persist()
        try:
            if orders.isEmpty():
                return
            refs = load()
            eligible = suggest.eligible_orders(orders, refs.customers, refs.methods)
            suggestions = suggest.recommend(eligible, refs.catalogue, refs.size).persist()
            try:
                write_topic(suggestions, topics, SUGGESTION_TOPIC, "order_id", number)
                write_topic(suggest.accepted(suggestions), topics, ACCEPTED_TOPIC, "order_id", number)
            finally:
                suggestions.unpersist()
        finally:
            orders.unpersist()

    return ready.writeStream.foreachBatch(batch).option("checkpointLocation", progress)


def load_suggestions(spark: SparkSession, lake: Lake, as_of: str | None = None) -> StreamingQuery | None:
    """Append the suggestions accepted since the last run to the raw layer, then stop.

    The progress folder remembers how far the topic was read, so nothing is loaded twice.
    Ingestion days must neither go back nor lie before the orders (but for one day, as clocks
    differ): later steps rely on it to leave older folders unread.
    """
    if as_of is not None:
        newest = newest_day(spark, lake.bronze(ACCEPTED_TOPIC))
        if newest is not None and as_of < newest:
            raise ValueError(f"as_of {as_of} lies before the suggestions already loaded on {newest}")
        ordered = newest_day(spark, lake.bronze("orders"))
        if ordered is not None and date.fromisoformat(as_of) + timedelta(days=1) < date.fromisoformat(ordered):
            raise ValueError(f"as_of {as_of} lies before the orders of {ordered}")
    if lake.topics.format != "kafka" and not has_data(spark, f"{lake.topics.path}/{ACCEPTED_TOPIC}"):
        return None
    options = {"startingOffsets": "earliest"} if lake.topics.format == "kafka" else {}
    records = stream_topic(spark, lake.topics, ACCEPTED_TOPIC, **options)
    query = (
        ingest.accepted_suggestions(records, as_of).writeStream.format("parquet")
        .partitionBy(*DATE_PARTS).option("checkpointLocation", lake.progress("order_suggestion_accepted"))
        .trigger(availableNow=True).start(lake.bronze("order_suggestion_accepted"))
    )
    query.awaitTermination()
    return query
