"""Blocks: many counted examples packed into one row of binary columns.

A training pass then hands each task a few large buffers instead of millions of small lists.
The numpy helpers below work on one block at a time; Spark spreads blocks and adds up results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK_SCHEMA = (
    "n DOUBLE, top INT, pos BINARY, neg BINARY, sizes BINARY, idx BINARY"
)


class Block(NamedTuple):
    pos: np.ndarray
    neg: np.ndarray
    sizes: np.ndarray
    idx: np.ndarray


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rows_to_block(batch: pa.RecordBatch) -> Block:
    """Arrow rows `pos, neg, idx LIST<INT>` as one block."""
    lists = _column(batch, "idx")
    return Block(
        _column(batch, "pos").cast(pa.float64()).to_numpy(zero_copy_only=False),
        _column(batch, "neg").cast(pa.float64()).to_numpy(zero_copy_only=False),
        np.diff(lists.offsets.to_numpy()).astype(np.int32),
        lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False),
    )


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks from Arrow batches of packed rows, or of plain example rows."""
    for batch in batches:
        if not pa.types.is_binary(_column(batch, "idx").type):
            if batch.num_rows:
                yield rows_to_block(batch)
            continue
        columns = [_column(batch, c) for c in Block._fields]
        for i in range(batch.num_rows):
            buffers = [c[i].as_buffer() for c in columns]
            yield Block(
                np.frombuffer(buffers[0], np.float64),
                np.frombuffer(buffers[1], np.float64),
                np.frombuffer(buffers[2], np.int32),
                np.frombuffer(buffers[3], np.int32),
            )


def _pack(block: Block, batch: int | None) -> dict:
    row = {
        "n": float(block.pos.sum() + block.neg.sum()),
        "top": int(block.idx.max(initial=-1)),
        "pos": block.pos.tobytes(),
        "neg": block.neg.tobytes(),
        "sizes": block.sizes.tobytes(),
        "idx": block.idx.tobytes(),
    }
    return row if batch is None else {"batch": batch, **row}


def _pick(block: Block, chosen: np.ndarray) -> Block:
    return Block(
        block.pos[chosen],
        block.neg[chosen],
        block.sizes[chosen],
        block.idx[np.repeat(chosen, block.sizes)],
    )


def pack(examples: DataFrame) -> DataFrame:
    """Examples `(pos, neg, idx)` to packed rows, one per Arrow batch. Narrow.

    A `batch` column is kept: each packed row then holds examples of one batch only.
    """
    by_batch = "batch" in examples.columns
    columns = ["batch"] if by_batch else []
    schema = ("batch INT, " if by_batch else "") + BLOCK_SCHEMA

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            block = rows_to_block(rows)
            if not by_batch:
                packed = [_pack(block, None)]
            else:
                number = _column(rows, "batch").to_numpy(zero_copy_only=False)
                packed = [_pack(_pick(block, number == b), int(b)) for b in np.unique(number)]
            yield pa.RecordBatch.from_pylist(packed, schema=_ARROW_BATCH if by_batch else _ARROW)

    return examples.select(*columns, "pos", "neg", "idx").mapInArrow(to_blocks, schema)


_ARROW = pa.schema(
    [("n", pa.float64()), ("top", pa.int32())]
    + [(c, pa.binary()) for c in ("pos", "neg", "sizes", "idx")]
)
_ARROW_BATCH = pa.schema([("batch", pa.int32()), *_ARROW])


def block_stats(blocks: DataFrame) -> tuple[int, int]:
    """(number of samples, highest dimension + 1) of packed rows."""
    n, top = blocks.agg(F.sum("n"), F.max("top")).first()
    if n is None:
        raise ValueError("no examples")
    return int(n), int(top) + 1


def few_tasks(blocks: DataFrame, tasks: int | None = None) -> tuple[DataFrame, int]:
    """Cached blocks with partitions merged, not moved, into `tasks` tasks; and their number.

    A task sends one partial gradient however many partitions it folds, so what is shuffled grows
    with the number of tasks and not with that of partitions. Unless given, it is one for each core,
    and at least the root of the number of partitions in case few cores are up yet.
    """
    now = blocks.rdd.getNumPartitions()
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(now, tasks or max(cores, isqrt(now))))
    return blocks.coalesce(tasks), tasks


def padded(vector: np.ndarray) -> np.ndarray:
    """`vector` with a zero at the end, where dimensions beyond the model are sent."""
    return np.append(vector, 0.0)


def clip(idx: np.ndarray, d: int) -> np.ndarray:
    """Dimensions >= d become d, the padding position."""
    return np.minimum(idx, d) if len(idx) and idx.max() >= d else idx


def row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of `sizes[i]` values; empty runs give zero."""
    if sizes.all():
        return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(row, weights=values, minlength=len(sizes))


def logistic(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def block_loss(block: Block, z: np.ndarray) -> float:
    tail = np.log1p(np.exp(-np.abs(z)))
    return float(block.pos @ (tail + np.maximum(-z, 0)) + block.neg @ (tail + np.maximum(z, 0)))
