"""Writers. Parquet is the normal form; text follows the line formats read elsewhere here.

All writes are distributed: `path` becomes a folder, text parts are in key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clicktide.functions.scalar import format_unsigned

TRACE_COLUMNS = (
    "loglik", "rtime", "alpha", "beta", "w_diff_norm", "w_norm",
    "w0", "grad_norm", "gtd", "gtold", "uhu",
)


def _write(table: DataFrame, path: str, fmt: str, lines) -> None:
    if fmt == "parquet":
        table.write.mode("overwrite").parquet(path)
    elif fmt == "text":
        lines(table).select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'text'")


def _pair(first: Column, second: str) -> Column:
    return F.concat_ws(" ", first, F.col(second).cast("string")).alias("value")


def dictionary_lines(dictionary: DataFrame) -> DataFrame:
    """`value`: `fid dim`, by dim."""
    return dictionary.orderBy("dim").select(_pair(format_unsigned(F.col("fid")), "dim"))


def write_dictionary(dictionary: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(dictionary.select("fid", "dim"), path, fmt, dictionary_lines)


def histogram_lines(histogram: DataFrame) -> DataFrame:
    """`value`: `fid n`, by fid."""
    return histogram.orderBy("fid").select(_pair(format_unsigned(F.col("fid")), "n"))


def write_histogram(histogram: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(histogram.select("fid", "n"), path, fmt, histogram_lines)


def every_index(weights: DataFrame) -> DataFrame:
    """`(idx, w)` for all indices up to the highest; those without a row weigh zero."""
    top = weights.agg(F.max("idx")).first()[0]
    every = weights.sparkSession.range(0 if top is None else int(top) + 1)
    given = weights.select(F.col("idx").alias("_idx"), "w")
    return every.join(given, F.col("id") == F.col("_idx"), "left").select(
        F.col("id").cast("int").alias("idx"), F.coalesce("w", F.lit(0.0)).alias("w")
    )


def weights_lines(weights: DataFrame) -> DataFrame:
    """`value`: one weight per line, line number = index; indices without a row weigh zero."""
    return every_index(weights).orderBy("idx").select(F.col("w").cast("string").alias("value"))


def write_weights(weights: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(weights.select("idx", "w"), path, fmt, weights_lines)


def feature_weights_lines(weights: DataFrame) -> DataFrame:
    """`value`: `fid w` from `weights_by_feature`; the bias has id 0."""
    fid = F.when(F.col("is_bias"), F.lit("0")).otherwise(F.col("fid"))
    return weights.select(_pair(fid, "w"))


def write_feature_weights(weights: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(weights.select("fid", "w", "is_bias"), path, fmt, feature_weights_lines)


def write_trace(trace: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Training trace; in text one folder per column with one value per line, in order of rounds."""
    if fmt == "parquet":
        trace.write.mode("overwrite").parquet(path)
        return
    order = [c for c in ("pass", "batch", "iter") if c in trace.columns]
    for column in TRACE_COLUMNS:
        lines = trace.orderBy(*order).select(F.col(column).cast("string").alias("value"))
        lines.write.mode("overwrite").text(f"{path}/{column}")


def samples_lines(samples: DataFrame) -> DataFrame:
    """`value`: a label line, an index line, a blank line."""
    label = F.col("y").cast("double").cast("string")
    indices = F.array_join(F.col("idx").cast("array<string>"), " ")
    return samples.select(F.concat(label, F.lit("\n"), indices, F.lit("\n")).alias("value"))


def write_samples(samples: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Labelled rows with `y` and `idx`."""
    _write(samples, path, fmt, samples_lines)
