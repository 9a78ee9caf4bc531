"""Column expressions: stable logistic maths, labels, unsigned 64-bit ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_UNSIGNED = "18446744073709551615"


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)); keeps the small tail instead of cancelling to zero."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_loss(z: Column) -> Column:
    """log(1 + exp(-z)) without overflow; `z` is label times margin."""
    return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def predict_label(z: Column) -> Column:
    """-1 below zero, else +1: a margin of exactly zero counts as positive."""
    return F.when(z < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def label01(y: Column) -> Column:
    """{-1, +1} to {0, 1}."""
    return (1 + y) / 2


def counted_loss(pos: Column, neg: Column, z: Column) -> Column:
    """Log loss of `pos` positive and `neg` negative samples that share the margin `z`."""
    return pos * log_loss(z) + neg * log_loss(-z)


def counted_residual(pos: Column, neg: Column, z: Column) -> Column:
    """d loss / d margin of the same samples: (sigmoid(z)-1) per positive, sigmoid(z) per negative."""
    s = sigmoid(z)
    return neg * s + pos * (s - 1)


def counted_curvature(pos: Column, neg: Column, z: Column) -> Column:
    """d2 loss / d margin2 of the same samples."""
    s = sigmoid(z)
    return (pos + neg) * s * (1 - s)


def parse_unsigned(text: Column) -> Column:
    """Unsigned decimal text to BIGINT (two's complement); NULL unless digits up to 2^64-1."""
    value = text.try_cast("decimal(20,0)")
    valid = text.rlike("^[+]?[0-9]+$") & (value <= F.lit(MAX_UNSIGNED).cast("decimal(20,0)"))
    wrap = F.lit("18446744073709551616").cast("decimal(20,0)")
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(valid, F.when(value >= half, value - wrap).otherwise(value).cast("bigint"))


def format_unsigned(bits: Column) -> Column:
    """BIGINT (two's complement) to unsigned decimal text."""
    # Not `conv`, which saturates at -2^63.
    wrap = F.lit("18446744073709551616").cast("decimal(20,0)")
    high = (bits.cast("decimal(20,0)") + wrap).cast("string")
    return F.when(bits >= 0, bits.cast("string")).otherwise(high)
