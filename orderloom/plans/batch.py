"""The batch run: raw layer, checks, conformed layer, checks, dimensions, fact, inspection.

Every step reads what earlier steps wrote and may be repeated: a step that was cut short picks
up where it stopped, and one that was complete finds nothing to do.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.config import (
    BRONZE_DIMENSIONS, BRONZE_RULES, DIMENSIONS, GROWING, SILVER_RULES, Dimension, Lake,
)
from orderloom.functions import date_parts
from orderloom.operators import clean, facts, incremental, quality, scd2
from orderloom.schemas import ACCEPTED_SUGGESTION
from orderloom.session import Scratch
from orderloom.sources import (
    accept_schema, append_partitioned, append_table, countable, countable_versioned, csv_rejects, has_data, key_store, latest_watermark, overwrite, read_csv_dimension, read_layer, read_table,
    merge_versions, read_since, read_versioned, seen_keys, settle, stored_schema, write_versioned,
)
from orderloom.sources.layers import read_merged, versioned_exists
from orderloom.streaming.suggestions import ACCEPTED_TOPIC, load_suggestions


class QualityError(RuntimeError):
    pass


@dataclass
class Run:
    """One batch run over a lake.

    ``as_of`` is the business date. ``ties="anti"`` also looks for unseen orders and dimension rows
    at the very instant of a watermark, which a strict comparison passes over.
    """

    spark: SparkSession
    lake: Lake
    scratch: Scratch
    as_of: str
    ties: str = "strict"

    def _newer(
        self, source: DataFrame, ts: str, target: str, lower: str | None,
        key: str | None = None, target_key: str | None = None, target_ts: str | None = None,
    ) -> DataFrame:
        """Rows of ``source`` beyond ``lower``, the watermark of the table at ``target``.

        Without a watermark that is everything for a new table and nothing for one that holds
        rows but no time at all: its rows would otherwise come again with every run.
        """
        if lower is None:
            return source.filter("false") if self._has(target) else source
        if key is None or self.ties == "strict":
            return incremental.newer_than(source, ts, lower)
        loaded = self._since(target, lower[:10]).select(
            F.col(target_key).alias(key), F.col(target_ts).alias(ts)
        )
        return incremental.newer_than(source, ts, lower, ties=self.ties, target=loaded, key=key)

    # Tables are only looked at through these: each first ends what an interrupted run left of its writes.

    def _has(self, path: str) -> bool:
        settle(self.spark, path)
        return has_data(self.spark, path)

    def _all(self, path: str) -> DataFrame:
        settle(self.spark, path)
        return read_layer(self.spark, path)

    def _since(self, path: str, day: str | None) -> DataFrame:
        settle(self.spark, path)
        return read_since(self.spark, path, day)

    def _watermark(self, path: str, ts: str) -> str | None:
        settle(self.spark, path)
        return latest_watermark(self.spark, path, ts)

    # Source tables

    def load_seed(self, table: str, file: str) -> None:
        """The lines of a seed file whose id ``table`` lacks, added to the source; lines that do not fit, to the rejects."""
        as_of = f"{self.as_of} 00:00:00"
        rows = self.scratch.stage(read_csv_dimension(self.spark, file, table, as_of), f"{table}-seed")
        known = f"{self.lake.source.path}/{table}"
        if self.lake.source.format == "jdbc" or has_data(self.spark, known):
            present = read_table(self.spark, self.lake.source, table).select("id")
            rows = self.scratch.stage(rows.join(present, "id", "left_anti").select(rows.columns), f"{table}-new")
        csv_rejects(self.spark, file, table, as_of).write.mode("append").parquet(self.lake.rejects(table))
        append_table(self.lake.source, table, rows)

    # Raw layer

    def load_orders(self) -> None:
        """New source orders and their lines.

        The new orders are staged first: the source is read once, and lines and orders are
        taken from the same rows whatever commits meanwhile. Orders hold the watermark and are
        appended last, so after an interruption the same orders come again; those whose lines
        already arrived are recognised.
        """
        target, lines_target = self.lake.bronze("orders"), self.lake.bronze("order_details")
        lower = self._watermark(target, "timestamp")
        source = read_table(self.spark, self.lake.source, "orders")
        newer = self._newer(source, "timestamp", target, lower, "id", "id", "timestamp")
        orders = self.scratch.stage(date_parts(newer, "timestamp"), "orders")
        if orders.isEmpty():
            return
        pending = orders
        if self._has(lines_target):
            pending = incremental.without_lines(
                orders, self._since(lines_target, lower and lower[:10])
            )
        details = read_table(self.spark, self.lake.source, "order_details", lower)
        append_partitioned(incremental.lines_of(pending, details), lines_target)
        append_partitioned(orders, target)

    def load_dimension_table(self, table: str) -> None:
        target = self.lake.bronze(table)
        lower = self._watermark(target, "updated_at")
        source = read_table(self.spark, self.lake.source, table)
        newer = self._newer(source, "updated_at", target, lower, "id", "id", "updated_at")
        append_partitioned(date_parts(newer, "updated_at"), target)

    def load_bronze(self) -> None:
        self.load_orders()
        settle(self.spark, self.lake.bronze("orders"))
        load_suggestions(self.spark, self.lake, self.as_of)
        for table in BRONZE_DIMENSIONS:
            self.load_dimension_table(table)

    # Checks

    def _tables(self, path, names) -> dict[str, DataFrame]:
        return {n: self._all(path(n)) for n in names if self._has(path(n))}

    def _check(self, layer: str, path, rules) -> DataFrame:
        """NULLs and minima are told by the file footers. Of the key columns of key rules, tables that only grow
        have their new files read, others all."""
        tables = self._tables(path, rules)
        footers = {n: countable(self.spark, path(n)) for n in tables}
        keys = {n: {r.column: self._keys(layer, n, path(n), r.column) for r in rules[n] if r.kind in quality.KEYED}
                for n in tables if n in GROWING}
        return quality.check_tables(tables, rules, footers, keys)

    def _keys(self, layer: str, table: str, path: str, column: str) -> DataFrame:
        store = self.lake.keys(layer, table, column)
        key_store.take_in(self.spark, store, path, column, self.scratch.stage)
        return key_store.measured(self.spark, store)

    def check_bronze(self) -> DataFrame:
        return self._check("bronze", self.lake.bronze, BRONZE_RULES)

    def check_schemas(self, accept: bool = False) -> dict[str, DataFrame]:
        """Differences per raw table. A table seen for the first time is accepted as it is; a
        changed one only with ``accept``."""
        found = {}
        for name, df in self._tables(self.lake.bronze, BRONZE_RULES).items():
            accepted = stored_schema(self.spark, self.lake.schema_store, name)
            if accepted is not None and not quality.same_schema(df.schema, accepted):
                found[name] = quality.schema_drift(df, accepted, name)
            if accepted is None or (accept and name in found):
                accept_schema(self.spark, self.lake.schema_store, name, df.schema)
        return found

    def check_silver(self) -> DataFrame:
        return self._check("silver", self.lake.silver, SILVER_RULES)

    # Conformed layer

    def build_silver_dimensions(self) -> None:
        def bronze(table: str) -> DataFrame:
            return self._all(self.lake.bronze(table))

        overwrite(clean.clean_stores(bronze("stores")), self.lake.silver("stores"))
        overwrite(
            clean.clean_products(bronze("products"), bronze("product_category")), self.lake.silver("products")
        )
        overwrite(clean.clean_payment_methods(bronze("payment_method")), self.lake.silver("payment_method"))
        overwrite(clean.clean_customers(bronze("customers")), self.lake.silver("customers"))

    def build_silver_facts(self) -> None:
        """New orders, their lines, and suggestions not taken in yet; again orders last.

        Suggestions are read from the newest delivery day taken in on: delivery days never go back and a run takes
        all suggestions there are. A repeat of an older one is known by its key (see ``sources.seen_keys``).
        A suggestion accepted after its order went into the fact stays among the lines here: the fact
        takes up orders once and does not return to them.
        """
        target, lines_target = self.lake.silver("orders"), self.lake.silver("order_details")
        lower = self._watermark(target, "timestamp")
        day = lower and lower[:10]
        recent = self._since(self.lake.bronze("orders"), day)
        orders = self._newer(recent, "timestamp", target, lower, "id", "order_id", "timestamp")
        if orders.isEmpty():
            return
        pending, store = orders, self.lake.keys("silver", "order_details", "suggestion")
        if self._has(lines_target):
            # Only lines of these orders can tell: none, unless a run was cut short. They are picked out first.
            loaded = clean.lines_among(orders, self._since(lines_target, day))
            pending = incremental.without_lines(orders, clean.own_lines(loaded, self._suggestions(day)))
            settle(self.spark, store)
            last = seen_keys.newest(self.spark, store)
            seen_keys.follow(self.spark, store, self._since(lines_target, last), self._suggestions(last))
        news = clean.unseen_suggestions(self._suggestions(seen_keys.newest(self.spark, store)))
        fresh = seen_keys.unseen(self.spark, store, self.scratch.stage(news, "suggestions"))
        lines = self._since(self.lake.bronze("order_details"), day)
        append_partitioned(clean.lines_among(pending, lines).unionByName(fresh), lines_target)
        append_partitioned(clean.clean_orders(orders), target)

    def _suggestions(self, day: str | None) -> DataFrame:
        """Accepted suggestions delivered on ``day`` or later."""
        path = self.lake.bronze(ACCEPTED_TOPIC)
        if self._has(path):
            return self._since(path, day)
        columns = f"{ACCEPTED_SUGGESTION}, year int, month int, day int"
        return self.spark.createDataFrame([], columns)

    # Serving layer

    def build_dimension(self, dim: Dimension, gate: bool = True) -> None:
        """First load, or the changes since. ``gate`` skips the comparison when no source row
        is newer than the newest version."""
        path, fmt = self.lake.gold(dim.name), self.lake.table_format
        source = self._all(self.lake.silver(dim.silver))
        if fmt == "merged":
            settle(self.spark, path)
        if not versioned_exists(self.spark, path, fmt):
            write_versioned(scd2.initial_load(source, dim, self.scratch.stage), path, fmt, key=dim.key)
            return
        target = read_versioned(self.spark, path, fmt)
        if gate and not scd2.has_updates(target, source, dim):
            return
        if fmt == "merged":
            current = read_merged(self.spark, path, current=True)
            merge_versions(self.spark, path, scd2.merge(current, target, source, dim, self.as_of, self.scratch.stage), dim.key)
            return
        write_versioned(scd2.apply(target, source, dim, self.as_of, self.scratch.stage), path, fmt)

    def build_fact(self, grain: str = "timestamp") -> None:
        """Append the lines of orders newer than the newest fact.

        An order's own lines lie under its date and a suggestion under the later day it came in,
        so folders before the watermark's day are not read; one more day is left for clocks
        that differ.
        """
        target = self.lake.gold("fact_orders")
        after = self._watermark(target, "order_date")
        day = after and after[:10]
        recent = self._since(self.lake.silver("orders"), day)
        if grain == "day":
            orders = facts.orders_after(recent, after, grain)
        else:
            orders = self._newer(recent, "timestamp", target, after, "order_id", "order_id", "order_date")
        if orders.isEmpty():
            return
        products, stores, methods = (
            read_versioned(self.spark, self.lake.gold(name), self.lake.table_format, current=True)
            for name in ("dim_products", "dim_stores", "dim_payment_method")
        )
        since = day and (date.fromisoformat(day) - timedelta(days=1)).isoformat()
        lines = self._since(self.lake.silver("order_details"), since)
        append_partitioned(facts.build_fact(orders, lines, products, stores, methods), target)

    def inspect(self) -> DataFrame:
        """Counts and columns of the serving layer, from file footers."""
        fmt = self.lake.table_format

        def fact() -> DataFrame:
            settle(self.spark, self.lake.gold("fact_orders"))
            return countable(self.spark, self.lake.gold("fact_orders"))

        tables = {
            f"gld.{d.name}": lambda d=d: countable_versioned(self.spark, self.lake.gold(d.name), fmt)
            for d in DIMENSIONS
        }
        return quality.inspect_tables(self.spark, {**tables, "gld.fact_orders": fact})

    def preview(self, rows: int = 5) -> DataFrame:
        """Some rows of every table of the serving layer that is there."""
        fmt, tables = self.lake.table_format, {}
        for dim in DIMENSIONS:
            path = self.lake.gold(dim.name)
            if versioned_exists(self.spark, path, fmt):
                tables[f"gld.{dim.name}"] = read_versioned(self.spark, path, fmt)
        if self._has(self.lake.gold("fact_orders")):
            tables["gld.fact_orders"] = self._all(self.lake.gold("fact_orders"))
        return quality.preview(tables, rows)


def run_batch(
    spark: SparkSession, lake: Lake, as_of: str | None = None, fail_on_error: bool = False, ties: str = "strict"
) -> dict[str, DataFrame]:
    """All steps in order. Returns the reports; failed checks stop the run only on request."""
    with Scratch(spark) as scratch:
        run = Run(spark, lake, scratch, as_of or date.today().isoformat(), ties)
        run.load_bronze()
        reports = {"bronze": run.check_bronze()}
        reports |= {f"schema of {name}": drift for name, drift in run.check_schemas().items()}
        _stop_if_failed(reports, fail_on_error)
        run.build_silver_dimensions()
        run.build_silver_facts()
        reports["silver"] = run.check_silver()
        _stop_if_failed({"silver": reports["silver"]}, fail_on_error)
        for dim in DIMENSIONS:
            run.build_dimension(dim)
        run.build_fact()
        reports["gold"] = run.inspect()
        return reports


def _stop_if_failed(reports: dict[str, DataFrame], fail_on_error: bool) -> None:
    if not fail_on_error:
        return
    for name, report in reports.items():
        failed = report.filter("NOT passed") if "passed" in report.columns else report
        if not failed.isEmpty():
            raise QualityError(f"{name}: {failed.collect()}")
