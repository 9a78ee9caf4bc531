"""Fixed-size summaries of feature ids that keep rows out of a shuffle and change no result.

A count-min sketch bounds how often an id was shown, from above; a Bloom filter says of an id that it
is not in a set, or that it may be. Both are built by tasks, added up in ranges, and sent to
tasks, which drop what an exact step behind the shuffle would drop anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clicktide.operators.reduce import RANGES, collect_ranges, in_ranges, sum_ranges

# Rows of counters, and counters in each: 64 MB in all.
DEPTH, WIDTH = 4, 1 << 21
# Bits of a Bloom filter for each entry, bits set by an entry, and the most bits: 512 MB.
BITS_PER_ENTRY, BITS_SET, MOST_BITS = 16, 5, 1 << 32

# Odd constants of the splitmix64 finaliser.
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


@dataclass
class CountMin:
    """`table[k]` adds up weights by the k-th hash of their id."""

    table: np.ndarray

    @classmethod
    def empty(cls, depth: int = DEPTH, width: int = WIDTH) -> CountMin:
        return cls(np.zeros((depth, width), np.int64))

    def _at(self, ids: np.ndarray, k: int) -> np.ndarray:
        return (_mixed(ids, k) % np.uint64(self.table.shape[1])).astype(np.int64)

    def add(self, ids: np.ndarray, weights: np.ndarray) -> None:
        for k in range(len(self.table)):
            np.add.at(self.table[k], self._at(ids, k), weights)

    def bound(self, ids: np.ndarray) -> np.ndarray:
        """At least the sum of weights of each id."""
        return np.min([self.table[k][self._at(ids, k)] for k in range(len(self.table))], axis=0)

    def share_above(self, threshold: int) -> float:
        """Share of unseen ids that the sketch would let pass."""
        return float(np.prod((self.table > threshold).mean(axis=1)))


def _shown(rows: DataFrame) -> DataFrame:
    """`(show, ids)` with no NULLs."""
    none = F.array().cast("array<bigint>")
    ids = F.concat(F.coalesce("feats", none), F.coalesce("common", none))
    return rows.select(
        F.coalesce(F.col("show").cast("bigint"), F.lit(0)).alias("show"),
        F.filter(ids, lambda f: f.isNotNull()).alias("ids"),
    )


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, shows) of a batch, each id once."""
    show = batch.column(0).to_numpy(zero_copy_only=False)
    if len(show) and show.min() < 0:
        raise ValueError("negative number of shows")
    lists = batch.column(1)
    ids, at = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
    total = np.zeros(len(ids), np.int64)
    np.add.at(total, at, np.repeat(show, np.diff(lists.offsets.to_numpy())))
    return ids, total


def exposure_sketch(
    impressions: DataFrame, depth: int = DEPTH, width: int = WIDTH, tasks: int | None = None
) -> CountMin:
    """The sketch of how often each feature was shown. `tasks` (by default four a core) send one each."""
    tasks = tasks or 4 * impressions.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = CountMin.empty(depth, width)
        for batch in batches:
            sketch.add(*_pairs(batch))
        yield from in_ranges(sketch.table.ravel())

    parts = _shown(impressions).coalesce(tasks).mapInArrow(run, RANGES)
    table = collect_ranges(sum_ranges(parts, tasks, np.int64), depth * width, np.int64)
    return CountMin(table.reshape(depth, width))


def possible_counts(impressions: DataFrame, sketch: CountMin, threshold: int) -> DataFrame:
    """`(fid, n)`: partial counts of features that may have been shown more than `threshold` times."""
    shared = impressions.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, n = _pairs(batch)
            keep = known.bound(ids) > threshold
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(n[keep])], ["fid", "n"])

    return _shown(impressions).mapInArrow(run, "fid LONG, n LONG")


@dataclass
class Bloom:
    """A filter of 64-bit words; all bits of an id lie in one word."""

    words: np.ndarray

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (_mixed(ids, 0) % np.uint64(len(self.words))).astype(np.int64)
        rest, bits = _mixed(ids, 1), np.zeros(len(ids), np.uint64)
        for k in range(BITS_SET):
            bits |= np.uint64(1) << ((rest >> np.uint64(6 * k)) & np.uint64(63))
        return at, bits

    def add(self, ids: np.ndarray) -> None:
        at, bits = self._places(ids)
        np.bitwise_or.at(self.words, at, bits)

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        at, bits = self._places(ids)
        return (self.words[at] & bits) == bits


def bloom_filter(dictionary: DataFrame, entries: int, bits: int = BITS_PER_ENTRY, most_bits: int = MOST_BITS) -> Bloom:
    """The filter of `dictionary (fid)` with `entries` rows, of `bits` bits for each up to `most_bits`.

    A fuller filter lets more unknown ids pass; none that is in the dictionary is ever held back.
    """
    size = max(1, min(entries * bits, most_bits) // 64)
    tasks = 4 * dictionary.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Bloom(np.zeros(size, np.uint64))
        for batch in batches:
            part.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
        yield from in_ranges(part.words)

    parts = dictionary.select("fid").coalesce(tasks).mapInArrow(run, RANGES)
    summed = sum_ranges(parts, tasks, np.uint64, op=np.bitwise_or)
    return Bloom(collect_ranges(summed, size, np.uint64))
