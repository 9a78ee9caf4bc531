"""Mini-batches: a batch number per example."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def batch_count(n: int, batch_size: int) -> int:
    """Number of batches for `n` samples; one more than needed when `n` divides evenly."""
    return n // batch_size + 1


def batch_of(n_batches: int, keys: Sequence[str], seed: int = 0) -> Column:
    """Repeatable random batch in [0, n_batches), equally likely, from a seeded hash of `keys`."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("bigint"), *keys), F.lit(n_batches)).cast("int")


def assign_batches(
    examples: DataFrame, n_batches: int, keys: Sequence[str], seed: int = 0
) -> DataFrame:
    """Adds `batch`. Unlike a random split this is one column, not one scan per batch."""
    return examples.withColumn("batch", batch_of(n_batches, keys, seed))
