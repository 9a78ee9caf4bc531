"""Packed examples as files: written once, read by every fit and by every batch of one.

    <path>/blocks[/batch=<b>]   packed rows (see `operators.blocks`)
    <path>/manifest             (batch, blocks, n, top) of each batch; written last

A task that runs again after its executor was lost reads its blocks, not the log behind them. A store
without a manifest was not finished and cannot be opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clicktide.operators.blocks import BLOCK_SCHEMA, pack
from clicktide.session import drop_path


class BlockStore:
    """A finished store of `n` samples with `d` dimensions."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path
        self.manifest = spark.read.parquet(f"{path}/manifest")
        n, top, batches = self.manifest.agg(F.sum("n"), F.max("top"), F.count("batch")).first()
        self.n, self.d = int(n or 0), 0 if top is None else top + 1
        schema = BLOCK_SCHEMA + (", batch INT" if batches else "")
        self.blocks = spark.read.schema(schema).parquet(f"{path}/blocks")

    def batch(self, number: int) -> DataFrame:
        """Blocks of one batch. Only its files are listed and read."""
        return self.blocks.filter(F.col("batch") == number).drop("batch")

    def drop(self) -> None:
        drop_path(self._spark, self.path)


def write_store(
    examples: DataFrame,
    path: str,
    n_batches: int | None = None,
    batch: Column | None = None,
    seed: int = 0,
    pieces: int = 1,
) -> BlockStore:
    """`examples (pos, neg, idx)` packed and written to `path`, which must not exist.

    With `n_batches`, each batch has files of its own, written by `pieces` tasks. An example's batch is
    `batch`, or by default random: a seeded hash of its place in the input, so that what the caller
    tells rows apart by does not matter. It is drawn once, by this write.
    """
    spark = examples.sparkSession
    blocks = f"{path}/blocks"
    if n_batches is None:
        pack(examples.select("pos", "neg", "idx")).write.parquet(blocks)
        sizes = spark.read.parquet(blocks).withColumn("batch", F.lit(None).cast("int"))
    else:
        place = F.monotonically_increasing_id()
        drawn = F.pmod(F.xxhash64(F.lit(seed).cast("bigint"), place), F.lit(n_batches))
        number = (drawn if batch is None else batch).cast("int").alias("batch")
        piece = F.pmod(F.xxhash64(F.lit(seed + 1).cast("bigint"), place), F.lit(pieces)).alias("_piece")
        rows = examples.select("pos", "neg", "idx", number, piece)
        placed = rows.repartition("batch", "_piece").sortWithinPartitions("batch")
        pack(placed).write.partitionBy("batch").parquet(blocks)
        sizes = spark.read.schema("n DOUBLE, top INT, batch INT").parquet(blocks)
    sizes.groupBy("batch").agg(
        F.count("*").alias("blocks"), F.sum("n").alias("n"), F.max("top").alias("top")
    ).write.parquet(f"{path}/manifest")
    return BlockStore(spark, path)
