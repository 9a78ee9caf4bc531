"""Norms and dot products of weight tables `(idx, <value>)`."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def norm2(table: DataFrame, column: str = "w") -> DataFrame:
    """One row: sqrt(v . v)."""
    v = F.col(column)
    return table.agg(F.coalesce(F.sqrt(F.sum(v * v)), F.lit(0.0)).alias("norm"))


def dot(left: DataFrame, right: DataFrame, a: str = "w", b: str = "w") -> DataFrame:
    """One row: sum of products over shared indices; an absent index counts as zero."""
    pairs = left.select("idx", F.col(a).alias("_a")).join(
        right.select("idx", F.col(b).alias("_b")), "idx"
    )
    return pairs.agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0.0)).alias("dot"))
