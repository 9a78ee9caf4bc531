"""Sums of long vectors over many tasks, by index range and in levels.

A task sends its partial vector in ranges of consecutive entries. A range is added up by groups of
`fan` senders, their results by groups again, until one row is left for each range. So no task
holds more than the ranges dealt to it, and no vector is taken apart into a row for each entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Entries of one range: half a megabyte.
RANGE = 1 << 16
# Partial vectors that one task adds up at a level.
FAN = 32

# `at` lists the places of `v` inside the range, and is empty where `v` has all of them.
RANGES = "key INT, n INT, at BINARY, v BINARY"
_NAMES = ["key", "n", "at", "v"]
_ARROW = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _row(key: int, part: np.ndarray, *more: int) -> pa.RecordBatch:
    at = np.flatnonzero(part)
    if 12 * len(at) < 8 * len(part):
        places, values = at.astype(np.int32).tobytes(), part[at].tobytes()
    else:
        places, values = b"", part.tobytes()
    arrays = [pa.array([x], t) for x, t in zip((key, len(part), places, values), _ARROW)]
    extra = [pa.array([x], pa.int32()) for x in more]
    return pa.RecordBatch.from_arrays([*arrays, *extra], _NAMES + ["_group"] * len(more))


def in_ranges(vector: np.ndarray, size: int = RANGE) -> Iterator[pa.RecordBatch]:
    """Rows `RANGES` of a partial vector of 8-byte numbers; ranges of zeros are not sent."""
    for key, start in enumerate(range(0, len(vector), size)):
        part = vector[start : start + size]
        if part.any():
            yield _row(key, part)


def _add(sums: dict, key, n: int, at: pa.Buffer, v: pa.Buffer, dtype, op) -> None:
    if key not in sums:
        sums[key] = np.zeros(n, dtype)
    values, total = np.frombuffer(v, dtype), sums[key]
    if len(values) == n:
        op(total, values, out=total)
    else:
        places = np.frombuffer(at, np.int32)
        total[places] = op(total[places], values)


def sum_ranges(
    parts: DataFrame, senders: int | None = None, dtype=np.float64, fan: int = FAN, op=np.add
) -> DataFrame:
    """One row `RANGES` for each range, from partial ones that `senders` tasks sent.

    Where their number is not known, `fan` groups are added up and then the groups. `op` joins two
    vectors; zero must be its neutral element.
    """
    senders = senders or fan * fan

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            key, n, at, v, group = batch.columns
            for i in range(batch.num_rows):
                place = (key[i].as_py(), group[i].as_py())
                _add(sums, place, n[i].as_py(), at[i].as_buffer(), v[i].as_buffer(), dtype, op)
        for (k, g), total in sums.items():
            yield _row(k, total, g)

    rows = parts.select(*_NAMES, F.spark_partition_id().alias("_group"))
    while senders > 1:
        senders = -(-senders // fan)
        group = (F.col("_group") % F.lit(senders)).alias("_group")
        dealt = rows.select(*_NAMES, group).repartition("key", "_group")
        rows = dealt.mapInArrow(fold, RANGES + ", _group INT")
    return rows.select(*_NAMES)


def collect_ranges(rows: DataFrame, length: int, dtype=np.float64, size: int = RANGE) -> np.ndarray:
    """The vector of `length` entries that `rows` hold, of one sender or of several."""
    out, table = np.zeros(length, dtype), rows.toArrow()
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            key, n, at, v = (c[i] for c in batch.columns)
            part = out[key.as_py() * size :][: n.as_py()]
            values = np.frombuffer(v.as_buffer(), dtype)
            if len(values) == len(part):
                part += values
            else:
                part[np.frombuffer(at.as_buffer(), np.int32)] += values
    return out


def range_entries(rows: DataFrame, dtype=np.float64, size: int = RANGE) -> DataFrame:
    """`(idx, v)`: the entries of summed ranges that are not zero."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, _, at, v = (c[i] for c in batch.columns)
                values, places = np.frombuffer(v.as_buffer(), dtype), np.frombuffer(at.as_buffer(), np.int32)
                if not len(places):
                    places = np.flatnonzero(values)
                    values = values[places]
                idx = places.astype(np.int64) + key.as_py() * size
                yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(values)], ["idx", "v"])

    kind = "DOUBLE" if np.dtype(dtype) == np.float64 else "BIGINT"
    return rows.mapInArrow(unfold, f"idx BIGINT, v {kind}")
