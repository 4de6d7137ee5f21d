"""Gap-free row numbers in key order, by a prefix sum over ranges of the key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``monotonically_increasing_id`` holds the partition above these bits and the place in it below.
PLACE_BITS = 33


def number_rows(
    df: DataFrame, by: str, name: str, start: int = 0, stage: Callable[[DataFrame, str], DataFrame] | None = None
) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in the order of the unique column ``by``.

    The rows are dealt to tasks by ranges of the key and sorted there, and written once with the number of
    their range and their place in it. A count per range then says how many rows lie before it. No task
    sees more than its range, and where the ranges are cut never changes a number.
    """
    if stage is None:
        from orderloom.session import stage
    id = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_id", id)
    placed = stage(ranged, "numbered")
    part, place = F.shiftright("_id", PLACE_BITS), F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = dict(placed.groupBy(part.cast("int").alias("p")).agg(F.max(place).alias("last")).collect())  # one row per range
    before, total = [], start
    for p in range(max(sizes, default=-1) + 1):
        before.append(F.lit(total).cast("bigint"))
        total += sizes.get(p, -1) + 1
    offsets = F.array(*before) if before else F.array(F.lit(start).cast("bigint"))
    return placed.withColumn(name, place + F.element_at(offsets, part.cast("int") + 1)).drop("_id")
