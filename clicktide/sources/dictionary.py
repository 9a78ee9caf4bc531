"""Feature dictionary files: `id dim` per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from clicktide.functions.scalar import parse_unsigned


def read_dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their place in the input: file, block, position in the block."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def parse_dictionary(lines: DataFrame, place: Sequence[str] = ("file", "block", "at")) -> DataFrame:
    """`(fid, dim, place)`; lines without exactly two space-separated tokens are ignored."""
    # Trailing blanks make no token of their own.
    tokens = lines.withColumn("_tokens", F.split(F.rtrim("value"), " ")).filter(
        F.size("_tokens") == 2
    )
    return tokens.select(
        parse_unsigned(F.get("_tokens", F.lit(0))).alias("fid"),
        F.get("_tokens", F.lit(1)).cast("int").alias("dim"),
        F.struct(*place).alias("place"),
    ).filter(
        F.when(F.col("fid").isNotNull(), F.lit(True)).otherwise(
            F.raise_error(F.lit("malformed feature id in dictionary")).cast("boolean")
        )
    )


def last_wins(entries: DataFrame, key: str) -> DataFrame:
    """One row per `key` (`fid`, or `dim` for the reverse mapping): the last line counts."""
    other = "dim" if key == "fid" else "fid"
    return entries.groupBy(key).agg(F.max_by(other, "place").alias(other)).select("fid", "dim")


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """`(fid, dim)` with unique `fid` from dictionary text."""
    return last_wins(parse_dictionary(read_dictionary_lines(spark, path)), "fid")


def load_reverse_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """`(fid, dim)` with unique `dim` from dictionary text."""
    return last_wins(parse_dictionary(read_dictionary_lines(spark, path)), "dim")
