"""Data-quality checks: rules are data, results are rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from orderloom.config import Rule

RESULT = "table_name string, column_name string, rule string, value double, passed boolean, message string"
KEYED = ("repeated_keys", "uniqueness")


def check_table(
    df: DataFrame, table: str, rules: Iterable[Rule], counted: DataFrame | None = None,
    measured: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Results of all rules on one table, one row each.

    Every rule that needs only counts or minima shares a single pass over the table; ``counted``, if given, is
    the same table as it is to be read for them (see ``sources.countable``). Key rules count rows per
    value first, which each task reduces before the shuffle; for columns in ``measured`` the numbers are
    there already (see ``sources.key_store``).
    """
    rules = list(rules)
    simple = [r for r in rules if r.kind not in KEYED]
    keyed = {r.column: [k for k in rules if k.kind in KEYED and k.column == r.column]
             for r in rules if r.kind in KEYED}
    parts = []
    if simple:
        parts.append(_rows(_measure(df if counted is None else counted, simple), table, simple))
    for column, on_column in keyed.items():
        known = (measured or {}).get(column)
        parts.append(_rows(_measure_key(df, column) if known is None else known, table, on_column))
    return reduce(DataFrame.unionByName, parts)


def _measure(df: DataFrame, rules: list[Rule]) -> DataFrame:
    nulls = {r.column for r in rules if r.kind != "minimum"}
    minima = {r.column for r in rules if r.kind == "minimum"}
    plain = df.agg(  # nothing but counts and minima of columns: file footers can answer them
        F.count(F.lit(1)).alias("rows"),
        *(F.count(c).alias(f"present_{c}") for c in sorted(nulls)),
        *(F.min(c).alias(f"min_{c}") for c in sorted(minima)),
    )
    return plain.select(
        "rows",
        *((F.col("rows") - F.col(f"present_{c}")).alias(f"nulls_{c}") for c in sorted(nulls)),
        *(F.col(f"min_{c}").cast("double").alias(f"min_{c}") for c in sorted(minima)),
    )


def _measure_key(df: DataFrame, column: str) -> DataFrame:
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.col(column).isNotNull()).alias("distinct"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )


def _rows(measured: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    results = []
    for rule in rules:
        value, passed, message = _judge(rule)
        results.append(F.struct(
            F.lit(table).alias("table_name"), F.lit(rule.column).alias("column_name"),
            F.lit(rule.kind).alias("rule"), value.cast("double").alias("value"),
            F.coalesce(passed, F.lit(False)).alias("passed"), message.alias("message"),
        ))
    return measured.select(F.inline(F.array(*results)))


def _judge(rule: Rule) -> tuple[Column, Column, Column]:
    """Value, verdict and wording of a rule over the measured columns."""
    rows, limit = F.col("rows"), F.lit(float(rule.threshold))
    nulls = F.col(f"nulls_{rule.column}")
    if rule.kind == "null_ratio":
        return nulls, ~(nulls > limit * rows), F.concat_ws(" ", nulls, F.lit("of"), rows, F.lit("values are NULL"))
    if rule.kind == "completeness":
        present = rows - nulls
        share = F.when(rows > 0, present / rows)  # an empty table has no completeness and fails
        return share, share >= limit, F.concat_ws(" ", present, F.lit("of"), rows, F.lit("values are present"))
    if rule.kind == "minimum":
        low = F.col(f"min_{rule.column}")
        text = F.when(low < limit, "value below the minimum").when(low.isNull(), "no value")
        return low, low >= limit, F.coalesce(text, F.lit("no value below the minimum"))
    if rule.kind == "repeated_keys":
        repeated = F.col("repeated")
        return repeated, repeated <= limit, F.concat_ws(" ", repeated, F.lit("values occur more than once"))
    if rule.kind == "uniqueness":
        distinct = F.col("distinct")
        extra = rows - distinct
        return extra, extra <= limit, F.concat_ws(" ", distinct, F.lit("distinct of"), rows, F.lit("rows"))
    raise ValueError(f"unknown rule {rule.kind!r}")


def check_tables(
    tables: dict[str, DataFrame], rules: dict[str, list[Rule]], counted: dict[str, DataFrame] | None = None,
    measured: dict[str, dict[str, DataFrame]] | None = None,
) -> DataFrame:
    counted, measured = counted or {}, measured or {}
    parts = [check_table(tables[t], t, rules[t], counted.get(t), measured.get(t)) for t in rules if t in tables]
    return reduce(DataFrame.unionByName, parts)


def same_schema(actual: T.StructType, accepted: T.StructType) -> bool:
    """Exact equality: names, order, types and nullability."""
    return actual.jsonValue() == accepted.jsonValue()


def schema_drift(df: DataFrame, accepted: T.StructType, table: str) -> DataFrame:
    """One row per difference between a table and its accepted schema.

    ``values_present`` counts the rows that carry a value in the differing column, in one pass
    over those columns; it is 0 for a column that is gone.
    """
    old = {f.name: (i, f) for i, f in enumerate(accepted.fields)}
    new = {f.name: (i, f) for i, f in enumerate(df.schema.fields)}
    shared_old = [n for n in old if n in new]
    shared_new = [n for n in new if n in old]
    found = []
    for name in [*old, *(n for n in new if n not in old)]:
        before, after = old.get(name), new.get(name)
        if after is None:
            found.append((name, "removed", before[1].dataType.simpleString(), None))
        elif before is None:
            found.append((name, "added", None, after[1].dataType.simpleString()))
        else:
            types = (before[1].dataType.simpleString(), after[1].dataType.simpleString())
            if before[1].dataType.jsonValue() != after[1].dataType.jsonValue():
                found.append((name, "retyped", *types))
            elif before[1].nullable != after[1].nullable:
                found.append((name, "nullability", *types))
            elif before[1].metadata != after[1].metadata:
                found.append((name, "metadata", *types))
            if shared_old.index(name) != shared_new.index(name):
                found.append((name, "moved", *types))
    text = "string"
    rows = [
        F.struct(
            F.lit(table).alias("table_name"), F.lit(name).alias("column_name"), F.lit(change).alias("change"),
            F.lit(before).cast(text).alias("expected_type"), F.lit(after).cast(text).alias("actual_type"),
            (F.col(f"present_{name}") if name in new else F.lit(0).cast("bigint")).alias("values_present"),
        )
        for name, change, before, after in found
    ]
    if not rows:
        empty = (
            "table_name string, column_name string, change string, "
            "expected_type string, actual_type string, values_present bigint"
        )
        return df.sparkSession.createDataFrame([], empty)
    counted = {name for name, *_ in found if name in new}
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"present_{c}") for c in sorted(counted)))
    return totals.select(F.inline(F.array(*rows)))


INSPECTION = "table_name string, row_count bigint, column_count int, columns string, error string"


def inspect_tables(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Count and columns of each table, or the reason it could not be read."""
    parts = []
    for name, read in tables.items():
        try:
            df = read()
            listed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"),
                F.lit(listed).alias("columns"), F.lit(None).cast("string").alias("error"),
            ))
        except (AnalysisException, FileNotFoundError) as problem:
            reason = f"cannot read: {type(problem).__name__}"
            parts.append(spark.createDataFrame([(name, None, None, None, reason)], INSPECTION))
    return reduce(DataFrame.unionByName, parts)


def preview(tables: dict[str, DataFrame], rows: int = 5, order: dict[str, list[str]] | None = None) -> DataFrame:
    """A few rows of each table, each as one VARIANT, so that tables of any columns lie in one frame.

    Which rows is left to Spark, which stops once it has enough; a table named in ``order`` is sorted by
    those columns first (a top-k: tasks keep ``rows`` rows each).
    """
    shown = []
    for name, df in tables.items():
        first = df.orderBy(*order[name]) if order and name in order else df
        shown.append(first.limit(rows).select(
            F.lit(name).alias("table_name"), F.to_variant_object(F.struct(*df.columns)).alias("fields")))
    return reduce(DataFrame.unionByName, shown)
