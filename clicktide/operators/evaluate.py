"""Prediction and quality of a model on rows `(.., pos, neg, z)` from `with_margin` or
`margins_join`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clicktide.functions.scalar import counted_loss, format_unsigned, predict_label, sigmoid


def predict(margins: DataFrame) -> DataFrame:
    """Adds `p`, the probability of a click, and `label` in {-1, +1}."""
    return margins.withColumns({"p": sigmoid(F.col("z")), "label": predict_label(F.col("z"))})


def accuracy(margins: DataFrame) -> DataFrame:
    """One row: share of samples predicted right; NULL without samples."""
    right = F.when(predict_label(F.col("z")) > 0, F.col("pos")).otherwise(F.col("neg"))
    return margins.agg(
        F.try_divide(F.sum(right).cast("double"), F.sum(F.col("pos") + F.col("neg"))).alias(
            "accuracy"
        )
    )


def objective(margins: DataFrame, weights: DataFrame, lam: float) -> DataFrame:
    """One row: `(lam/2 w.w + total log loss) / n`, and the loss itself."""
    w2 = weights.agg(F.sum(F.col("w") * F.col("w")).alias("w2"))
    sums = margins.agg(
        F.sum(counted_loss(F.col("pos"), F.col("neg"), F.col("z"))).alias("loss"),
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
    )
    # Both sides are global aggregates of exactly one row.
    one = sums.withColumn("_one", F.lit(1)).join(w2.withColumn("_one", F.lit(1)), "_one")
    return one.select(
        ((F.lit(lam / 2) * F.col("w2") + F.col("loss")) / F.col("n")).alias("objective"), "loss"
    )


def _local_area(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low, pos_total, neg_total, area = None, 0.0, 0.0, 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        score, pos, neg = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        below = neg_total + np.cumsum(neg) - neg / 2
        area += float(pos @ below)
        pos_total += float(pos.sum())
        neg_total += float(neg.sum())
        low = float(score[0]) if low is None else low
    if low is not None:
        yield pa.RecordBatch.from_pydict(
            {"low": [low], "pos": [pos_total], "neg": [neg_total], "area": [area]}
        )


def auc_roc(margins: DataFrame, digits: int | None = None) -> DataFrame:
    """One row: area under the ROC curve by exact mid-ranks; NULL if one class is missing.

    Equal scores are merged first, so a score shared by many rows becomes one row. Score ranges
    are then swept in parallel, each yielding its own area and class totals; the pairs across
    ranges follow from those totals. `digits` rounds scores before ties are formed.
    """
    score = sigmoid(F.col("z"))
    if digits is not None:
        score = F.round(score, digits)
    tied = margins.groupBy(score.alias("score")).agg(
        F.sum(F.col("pos").cast("double")).alias("pos"),
        F.sum(F.col("neg").cast("double")).alias("neg"),
    )
    ranges = (
        tied.repartitionByRange("score")
        .sortWithinPartitions("score")
        .mapInArrow(_local_area, "low DOUBLE, pos DOUBLE, neg DOUBLE, area DOUBLE")
    )
    # One row per range: as many rows as tasks, not as scores.
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    pairs = ranges.select("pos", "neg", (F.col("area") + F.col("pos") * lower).alias("area"))
    return pairs.agg(
        F.try_divide(F.sum("area"), F.sum("pos") * F.sum("neg")).alias("auc")
    )


def weights_by_feature(weights: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`(fid STRING unsigned, w, is_bias)`: weights under the original feature ids.

    Dimensions the dictionary does not know are left out. The bias has its own flag, so a real
    feature 0 cannot collide with it.
    """
    features = weights.filter("idx > 0").join(
        dictionary.select("fid", F.col("dim").alias("idx")), "idx"
    )
    named = features.select(
        format_unsigned(F.col("fid")).alias("fid"), "w", F.lit(False).alias("is_bias")
    )
    bias = weights.filter("idx = 0").select(
        F.lit(None).cast("string").alias("fid"), "w", F.lit(True).alias("is_bias")
    )
    return named.unionByName(bias)
