"""Size of an example set and of a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def data_stats(examples: DataFrame) -> DataFrame:
    """One row: `n` samples and `d` = highest active dimension + 1 (NULL without examples)."""
    return examples.agg(
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).cast("bigint").alias("n"),
        (F.max(F.array_max("idx")) + 1).alias("d"),
    )


def dictionary_dim(dictionary: DataFrame) -> DataFrame:
    """One row: upper bound `dict_d` of the feature space, bias included."""
    return dictionary.agg((F.coalesce(F.max("dim"), F.lit(0)) + 1).alias("dict_d"))
