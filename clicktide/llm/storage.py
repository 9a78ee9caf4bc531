"""Tables written once to the shared checkpoint folder, and row numbers over such tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clicktide.session import scratch_path


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared checkpoint folder and read again.

    Cuts lineage like `checkpoint()`, but compressed and prunable by column. It survives lost
    executors. The folder may be emptied once the results made from it are written; `session.scratch`
    does so for a step.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """0, 1, .. along `order` over all rows, sorted in parallel ranges; the result is stored.

    Rows that tie in `order` are numbered in any order, but each number is given once.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", 33))
    )
    fixed = stored(ranged)
    # One row per range, as many as there were tasks.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_range")
        .count()
        .select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        fixed.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_before") + inside)
        .drop("_range", "_at", "_before")
    )
