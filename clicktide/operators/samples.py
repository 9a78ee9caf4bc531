"""Between counted examples `(.., pos, neg, idx)` and labelled samples `(.., y, .., idx)`."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


# Samples written out at a time.
EXPAND_PIECE = 100_000


def weighted_samples(examples: DataFrame) -> DataFrame:
    """At most two rows per example: `y` in {-1, +1} with weight `wt` = number of samples."""
    keep = [c for c in examples.columns if c not in ("pos", "neg")]
    both = F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("pos").alias("wt")),
        F.struct(F.lit(-1.0).alias("y"), F.col("neg").alias("wt")),
    )
    return (
        examples.select(*keep, F.explode(both).alias("_s"))
        .select(*keep, F.col("_s.y").alias("y"), F.col("_s.wt").alias("wt"))
        .filter("wt > 0")
    )


def expanded_samples(examples: DataFrame) -> DataFrame:
    """One row per sample, `k` = 1, 2, ..; the positive ones come first."""
    keep = [c for c in examples.columns if c not in ("pos", "neg")]
    total = F.col("pos") + F.col("neg")
    size = F.lit(EXPAND_PIECE).cast("bigint")
    # In two steps, so that a slot with very many shows never becomes one huge array.
    first = F.sequence(F.lit(1).cast("bigint"), total, size)
    pieces = examples.filter(total > 0).select(
        *keep, "pos", total.alias("_total"), F.explode(first).alias("_from")
    )
    piece = F.sequence("_from", F.least(F.col("_from") + size - 1, F.col("_total")))
    return pieces.select(*keep, "pos", F.explode(piece).alias("k")).select(
        *keep, "k", F.when(F.col("k") <= F.col("pos"), 1.0).otherwise(-1.0).alias("y")
    )


def count_samples(samples: DataFrame) -> DataFrame:
    """Labelled rows `(.., y, idx)`, optionally weighted by `wt`, as counted examples.

    Labels other than -1 and +1 fail the job.
    """
    keep = [c for c in samples.columns if c not in ("y", "wt")]
    weight = F.col("wt") if "wt" in samples.columns else F.lit(1).cast("bigint")
    y = F.when(F.abs("y") == 1, F.col("y")).otherwise(
        F.raise_error(F.lit("label must be -1 or +1")).cast("double")
    )
    positive = y > 0
    return samples.select(
        *keep,
        F.when(positive, weight).otherwise(0).alias("pos"),
        F.when(positive, 0).otherwise(weight).alias("neg"),
    )
