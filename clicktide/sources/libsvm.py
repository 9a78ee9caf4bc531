"""Sparse binary examples in the `y idx:val idx:val ..` text format; values are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clicktide.sources.impressions import read_lines


AROUND = r"^[\x00-\x20]+|[\x00-\x20]+$"


def parse_examples(lines: DataFrame) -> DataFrame:
    """`value` to `y DOUBLE, idx ARRAY<INT>`: bias 0 first, then indices in file order.

    White space around a line, TABs included, does not count, and lines of nothing else are
    skipped. A malformed number fails the job.
    """
    keep = [c for c in lines.columns if c != "value"]
    text = lines.withColumn("_text", F.regexp_replace("value", AROUND, "")).filter(F.col("_text") != "")
    tokens = text.withColumn("_tokens", F.split("_text", "[ \t\n]"))
    pairs = F.slice("_tokens", 2, F.size("_tokens") - 1)
    idx = F.transform(pairs, lambda t: F.split(t, ":")[0].cast("int"))
    return tokens.select(
        *keep,
        F.get("_tokens", F.lit(0)).cast("double").alias("y"),
        F.concat(F.array(F.lit(0)), idx).alias("idx"),
    )


def read_examples(
    spark: SparkSession, path: str, min_partitions: int | None = None
) -> DataFrame:
    """Labelled examples `(id, y, idx)` from text files."""
    return parse_examples(read_lines(spark, path, min_partitions).withColumnRenamed("req", "id"))
