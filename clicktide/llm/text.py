"""Words, word hashes and word windows of whole texts, computed over Arrow string buffers.

All functions work on the UTF-8 bytes of a slice of documents at once; a slice holds whole
documents and about `SLICE_BYTES` of text, so that memory does not depend on the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 19

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Gives memory that is free in this process back to the system.

    A Python worker waits for a minute after its task, and would hold it beside those that run.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Run) -> Run:
    """`run` for `mapInArrow`, with a `release` at the end of each task."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return through


# Odd multipliers of the byte and word polynomials, and of the splitmix64 finaliser.
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# ASCII other than letters and digits separates words of the license scan.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, inverse: bool, n: int) -> np.ndarray:
    """base**i, or its inverse, modulo 2**64 for i < n."""
    known = _powers.get((base, inverse))
    if known is None or len(known) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = max(n, SLICE_BYTES + 1)
        known = np.full(size, step, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[base, inverse] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any spans of a sequence from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self._inverse = _power(base, True, n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(base, False, n), dtype=np.uint64, out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(MIX_1))


class Slice:
    """Some whole documents: bytes, document bounds, word bounds and the document of each word."""

    def __init__(self, first: int, raw: np.ndarray, bounds: np.ndarray, separator: np.ndarray):
        self.first, self.raw, self.bounds = first, raw, bounds
        self.n = len(bounds) - 1
        self.in_word = ~separator[raw]
        starts, ends = bounds[:-1], bounds[1:]
        full = ends > starts
        before = np.empty(len(raw), bool)
        before[1:] = self.in_word[:-1]
        before[starts[full]] = False
        after = np.empty(len(raw), bool)
        after[:-1] = self.in_word[1:]
        after[ends[full] - 1] = False
        self.starts = np.flatnonzero(self.in_word & ~before)
        self.ends = np.flatnonzero(self.in_word & ~after) + 1
        # Where the words of each document begin in `starts`.
        self.word_bounds = np.searchsorted(self.starts, bounds)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.word_bounds))

    def bytes_hashed(self) -> Spans:
        return Spans(self.raw.astype(np.uint64) + np.uint64(1), BYTE_BASE)

    def word_hashes(self) -> np.ndarray:
        return self.bytes_hashed().hashes(self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """First word of each run of `size` words inside one document."""
        n = len(self.doc) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])

    def per_doc(self, flags: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
        """Sum of `flags` by document, for one flag per byte or per entry of `bounds`."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.bounds if bounds is None else bounds])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind, n + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    column: pa.Array, separator: np.ndarray = WHITE, lower: bool = False
) -> Iterator[Slice]:
    """The documents of a text column in slices."""
    raw, offsets = buffers(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(n, max(last, first + 1))
        part = raw[offsets[first] : offsets[last]]
        yield Slice(first, LOWER[part] if lower else part, offsets[first : last + 1] - offsets[first], separator)
        first = last


def measured(
    df: DataFrame,
    fields: list[tuple[str, str]],
    measure: Callable[[Slice], list],
    column: str = "text",
    separator: np.ndarray = WHITE,
    lower: bool = False,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """`df` with the columns `fields` (name, type) that `measure` computes from slices of `column`.

    A column of `df` named like an added one is replaced, those in `drop` are left out.
    """
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    out = {n.lower() for n, _ in fields} | {n.lower() for n in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in out]
    types = to_arrow_schema(added).types
    # Columns are found by place, so that names may repeat or clash.
    at = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in out]
    text_at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(s) for s in slices(batch.column(text_at), separator, lower)]
            new = []
            for i, kind in enumerate(types):
                arrays = [p[i] for p in parts]
                if not arrays:
                    new.append(pa.array([], kind))
                elif isinstance(arrays[0], np.ndarray):
                    new.append(pa.array(np.concatenate(arrays)).cast(kind))
                elif isinstance(arrays[0], pa.Array):
                    new.append(pa.concat_arrays(arrays).cast(kind))
                else:
                    new.append(pa.array([x for a in arrays for x in a], kind))
            names = [f.name for f in keep] + [f.name for f in added]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in at] + new, names)

    return df.mapInArrow(released(run), T.StructType(keep + added.fields))
