"""Gathering an order and its lines from one stream of events, each order announced once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orderloom.schemas import READY_ORDER
from orderloom.session import DEFAULTS, STATE_STORE

READY = READY_ORDER + ", ready_at timestamp"

# Fixed values, in seconds: how long half an order is kept, and how long a finished one is
# remembered so that it is not announced again.
ASSEMBLY_HORIZON = 120
DEDUP_HORIZON = 100

_TIMED = (
    "kind string, order_id string, customer_id string, payment_method_id string, num_products int, "
    "product_id string, event_time timestamp, at bigint"
)
_EMITTED = READY_ORDER + ", ready_at bigint"
# Orders share state by groups: a call between Python and the state store serves all orders of a group that have
# events. The number belongs to a query's progress and is not to be changed under it.
GROUPS = 4096
_EVENTS = pa.schema([
    ("order_id", pa.string()), ("at", pa.int64()), ("product_id", pa.string()), ("customer_id", pa.string()),
    ("payment_method_id", pa.string()), ("num_products", pa.int64()),
])
_OPEN = pa.schema([
    ("order_id", pa.string()), ("customer_id", pa.string()), ("payment_method_id", pa.string()), ("num_products", pa.int64()),
    ("info_until", pa.int64()), ("products", pa.list_(pa.string())), ("lines_until", pa.int64()), ("done_until", pa.int64()),
])
REMEMBERED = 200_000  # events a task keeps in mind to drop repeats


def ready_orders(
    *feeds: DataFrame,
    lateness: str = "120 seconds",
    horizon: int = ASSEMBLY_HORIZON,
    dedup: int = DEDUP_HORIZON,
    announced: DataFrame | None = None,
) -> DataFrame:
    """Orders whose set of products has reached the announced number.

    ``announced`` (order_id, ready_at) holds orders that an earlier query announced. A query that starts
    without progress of its own takes them as its first state and announces none of them again within
    ``dedup`` seconds; a query that goes on from its progress does not look at them.

    Events of all feeds meet in one shuffle, by groups of orders that share their state. Times are event times in whole
    seconds, as the horizons are. An order's events wait until the watermark has passed them and
    are then taken in by time, so neither the order of arrival nor the split into micro-batches
    changes a result; an order is announced ``lateness`` after its last event. Before the shuffle
    each task drops repeats within a second, so that an order with very many events does not
    reach its one state task event by event. Each feed has its own watermark and the slowest
    counts, so a feed that lags behind does not lose its events. The session must keep its state
    in the RocksDB store (``with_state_store``): no other has timers.
    """
    if feeds[0].sparkSession.conf.get(STATE_STORE, "") != DEFAULTS[STATE_STORE]:
        raise ValueError(f"set {STATE_STORE} to {DEFAULTS[STATE_STORE]}")
    known = None if announced is None else (
        announced.groupBy("order_id").agg(F.unix_seconds(F.max("ready_at")).alias("at")).withColumn("group", _group()).groupBy("group"))
    return (
        reduce(DataFrame.unionByName, [_timed(feed, lateness) for feed in feeds])
        .withColumn("group", _group())
        .groupBy("group")
        .transformWithStateInPandas(
            OrderAssembly(horizon, dedup), _EMITTED, outputMode="append", timeMode="eventTime", initialState=known)
        .withColumn("ready_at", F.timestamp_seconds("ready_at"))
    )


def _timed(feed: DataFrame, lateness: str) -> DataFrame:
    timed = feed.withColumns({
        "event_time": F.date_trunc("second", "event_time"), "at": F.unix_seconds("event_time"),
    })
    columns = [part.split()[0] for part in _TIMED.split(", ")]
    events = timed.select(columns).mapInPandas(drop_repeats, _TIMED).withWatermark("event_time", lateness)
    placed = F.col("kind").eqNullSafe("order")
    told = [F.when(placed, F.col(c)).alias(c) for c in ("customer_id", "payment_method_id")]
    return events.filter(placed | F.col("product_id").isNotNull()).select(
        "event_time", "order_id", "at", F.when(~placed, F.col("product_id")).alias("product_id"), *told,
        F.when(placed, F.coalesce("num_products", F.lit(0))).otherwise(0).cast("bigint").alias("num_products"))


def _group() -> Column:
    return F.pmod(F.xxhash64("order_id"), F.lit(GROUPS)).cast("int")


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams may use timers."""
    session = spark.newSession()
    session.conf.set(STATE_STORE, DEFAULTS[STATE_STORE])
    return session


def drop_repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches without events that the task has let through before; its memory is emptied when full."""
    seen: set[tuple] = set()
    for batch in batches:
        told = (batch[c] for c in batch.columns if c != "event_time")  # ``at`` is the same
        fresh = []
        for event in zip(*(c.astype(object).where(c.notna(), None).tolist() for c in told)):
            fresh.append(event not in seen)
            seen.add(event)
        yield batch[fresh]
        if len(seen) > REMEMBERED:
            seen.clear()


@dataclass
class Progress:
    """What is known of one order at a point in event time."""

    customer_id: str | None = None
    payment_method_id: str | None = None
    num_products: int = 0
    info_until: int = 0  # the announcement counts before this second
    products: frozenset[str] = frozenset()
    lines_until: int = 0  # and so do the products
    done_until: int = 0

    def take_in(self, now: int, events: list, horizon: int, dedup: int) -> list[str] | None:
        """All events of the second ``now``; the products, sorted, where they complete the order."""
        if now < self.done_until:
            return None
        if now >= self.lines_until:
            self.products = frozenset()
        for event in events:
            if event[1] is None:
                self.customer_id, self.payment_method_id, self.num_products = event[2:]
                self.info_until = now + horizon
            else:
                self.products |= {event[1]}
                self.lines_until = now + horizon
        if now >= self.info_until or len(self.products) != self.num_products:
            return None
        complete = sorted(self.products)
        self.products, self.info_until, self.lines_until, self.done_until = frozenset(), 0, 0, now + dedup
        return complete

    def ends(self) -> int:
        return max(self.info_until, self.lines_until, self.done_until)


def _in_time(event: tuple) -> tuple:
    """A total order of events, so that of two announcements in a second always the same one counts."""
    return event[0], event[1] is not None, tuple((v is not None, v or "") for v in event[1:4]), event[4] or 0


def _packed(columns: Iterable, schema: pa.Schema) -> bytes:
    table = pa.table([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema)], schema)
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, schema) as stream:
            stream.write_table(table)
        return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _rows(table: pa.Table) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in table.columns))


class OrderAssembly(StatefulProcessor):
    """State of a group of orders: parcels of events that the watermark has not passed, and the progress of orders.

    The announcement lives ``horizon`` seconds from the last order event and the product set
    ``horizon`` seconds from the last line. Events of the same second are taken in together
    before completeness is tested. A parcel is added as it comes; what is left of the parcels is written again
    when some of their events were due. One timer per group stands at its first waiting event or, if
    none waits, at the end of what it remembers.
    """

    def __init__(self, horizon: int, dedup: int):
        self.horizon = horizon
        self.dedup = dedup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.open = handle.getValueState("open", "orders binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = initialState[initialState["at"].notna()]
        orders = self._load()
        for order, at in zip(known["order_id"].tolist(), known["at"].tolist()):
            orders[order] = Progress(done_until=int(at) + self.dedup)
        if orders:
            self._save(orders)
            self._wake(max(p.ends() for p in orders.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for events in rows:
            self.waiting.appendValue((_packed((events[c] for c in _EVENTS.names), _EVENTS),))
            at = int(events["at"].min())
            first = at if first is None else min(first, at)
        if first is not None:
            timers = list(self.handle.listTimers())
            # One for the end of what is remembered may stand after the event: it is set again then.
            if not timers or first * 1000 < timers[0]:
                self._wake(first, timers)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000  # no event up to it can come any more
        due, rest = defaultdict(set), []
        for parcel in self.waiting.get():
            events = _unpacked(parcel[0])
            late = pc.greater(events["at"], passed)
            rest.append(events.filter(late))
            for order, *event in _rows(events.filter(pc.invert(late))):
                due[order].add(tuple(event))
        orders, ready = self._load(), []
        for order, events in due.items():
            progress = orders.setdefault(order, Progress())
            for now, together in groupby(sorted(events, key=_in_time), key=lambda e: e[0]):
                products = progress.take_in(now, list(together), self.horizon, self.dedup)
                if products is not None:
                    ready.append((order, progress.customer_id, progress.payment_method_id, products, now))
        left = pa.concat_tables(rest).group_by(_EVENTS.names).aggregate([]) if rest else None  # without repeats
        if due:
            if left.num_rows:
                self.waiting.put([(_packed(left.columns, _EVENTS),)])
            else:
                self.waiting.clear()
        orders = {order: p for order, p in orders.items() if p.ends() > passed}
        self._save(orders)
        if left is not None and left.num_rows:
            self._wake(pc.min(left["at"]).as_py(), [])
        elif orders:
            self._wake(max(p.ends() for p in orders.values()), [])
        names = [part.split()[0] for part in _EMITTED.split(", ")]
        return iter((pd.DataFrame(ready, columns=names),) if ready else ())

    def _wake(self, at: int, timers: list[int] | None = None) -> None:
        """One timer, in place of those that stand."""
        for timer in list(self.handle.listTimers()) if timers is None else timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at * 1000)

    def _load(self) -> dict[str, Progress]:
        saved = self.open.get()
        if saved is None:
            return {}
        return {order: Progress(*rest[:4], frozenset(rest[4]), *rest[5:]) for order, *rest in _rows(_unpacked(saved[0]))}

    def _save(self, orders: dict[str, Progress]) -> None:
        if not orders:
            self.open.clear()
            return
        rows = [
            (order, p.customer_id, p.payment_method_id, p.num_products, p.info_until, sorted(p.products), p.lines_until, p.done_until)
            for order, p in orders.items()]
        self.open.update((_packed(map(list, zip(*rows)), _OPEN),))
