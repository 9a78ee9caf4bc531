"""Row numbers over a total order without pulling a whole order or group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clicktide.session import materialise

# Groups larger than this are numbered across many tasks instead of in one window partition.
HOT_GROUP_ROWS = 2_000_000


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Dense numbers `start..` along `order`, which must be a total order.

    Range partitioning sorts in parallel; `monotonically_increasing_id` then gives the position
    inside each range. The ranges are materialised once, because a second execution may choose
    other bounds, and only one count per range is needed to turn positions into numbers.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", 33))
    )
    fixed = materialise(ranged)
    # One row per range, so this unpartitioned window holds as many rows as there were tasks.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_range")
        .count()
        .select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        fixed.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_before") + inside + F.lit(start))
        .drop("_range", "_at", "_before")
    )


def number_within(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """1, 2, .. along `order` inside each `group`; `group + order` must be a total order.

    Ordinary groups use a window. Groups above `hot_rows` rows, if a map-side combined count
    finds any, are numbered by `number_rows` and shifted to start at one.
    """
    group, order = list(group), list(order)
    window = Window.partitionBy(*group).orderBy(*order)
    hot = df.groupBy(*group).count().filter(F.col("count") > hot_rows).select(*group)
    if hot.isEmpty():
        return df.withColumn(name, F.row_number().over(window))
    hot = materialise(hot)
    hot = F.broadcast(hot)  # at most one group in `hot_rows` rows
    cold = df.join(hot, group, "left_anti").withColumn(name, F.row_number().over(window))
    spread = number_rows(
        df.join(hot, group, "left_semi"), [F.col(c) for c in group + order], "_number"
    )
    first = spread.groupBy(*group).agg(F.min("_number").alias("_first"))
    shifted = (
        spread.join(F.broadcast(first), group)
        .withColumn(name, (F.col("_number") - F.col("_first") + 1).cast("int"))
        .drop("_number", "_first")
    )
    return cold.unionByName(shifted)
