"""Embedding whitening: covariance of distinct vectors, each whitened once, joined back to its rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clicktide.llm.storage import stored
from clicktide.operators.reduce import RANGES, collect_ranges, in_ranges, sum_ranges

# An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Entries are kept inside +-LIMIT, so that they fit in a long.
LIMIT = 1 << 62
# Components whose share of the largest eigenvalue is below this have no variance but rounding.
FLAT = 1e-13
# Rows that a matrix product takes at once.
BLOCK_ROWS = 2048
# Vectors with at least so many copies, and as many as one in MOST_HOT rows, are looked up in place:
# there are at most MOST_HOT of them.
HOT_COPIES, MOST_HOT = 50_000, 10_000

# Longs are summed in parts of these bits, so that sums of any number of rows fit in longs.
_PARTS = (32, 16, 0)


@dataclass
class Whitening:
    """A fitted transform: `n` and integer sums, the largest eigenvalues and their directions."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    directions: np.ndarray
    trace: float

    @property
    def good(self) -> np.ndarray:
        """Components that have variance."""
        top = self.eigenvalues.max(initial=0.0)
        return self.eigenvalues > FLAT * top * max(len(self.sums), 1)


def whole_numbers(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """`(keep.., _x BINARY, _name BINARY)`: rows with a usable vector, its numbers x as longs, and
    a 128-bit digest of them.

    Null vectors, those with null or non-finite entries, and those without entries are left out.
    """
    value = F.col(vector)
    usable = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.filter(F.coalesce((F.size(value) > 0) & usable, F.lit(False)))
    rows = rows.select(*keep, value.cast("array<double>").alias("_x"))
    fields = [f for f in rows.schema.fields if f.name != "_x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT
            bounds = (np.asarray(column.offsets) - column.offsets[0].as_py()) * 8
            raw = x.tobytes()
            parts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            names = [hashlib.blake2b(p, digest_size=16).digest() for p in parts]
            arrays = [*batch.columns[:-1], pa.array(parts, pa.binary()), pa.array(names, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in fields), "_x", "_name"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "_x BINARY, _name BINARY"
    return rows.mapInArrow(run, schema)


def distinct(rows: DataFrame) -> DataFrame:
    """`(_x, _name, copies)`: each vector of `whole_numbers` once; copies meet in the map side."""
    return stored(rows.groupBy("_name", "_x").agg(F.count("*").alias("copies")))


def _blocks(batches: Iterator[pa.RecordBatch], d: int, weights: str) -> Iterator[tuple]:
    """(batch, vectors, weights) of at most BLOCK_ROWS rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            column = part.column(part.schema.get_field_index("_x"))
            x = np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(part.num_rows, d)
            copies = part.column(part.schema.get_field_index("copies")).to_numpy()
            yield part, x, copies if weights == "count" else np.ones(len(x), np.int64)


def _added(fit: DataFrame, d: int, length: int, dtype, weights: str, fold) -> np.ndarray:
    """The sum over all rows of `fold(vectors, weights)`, a vector of `length` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, dtype)
        for _, x, w in _blocks(batches, d, weights):
            total += fold(x, w)
        yield from in_ranges(total)

    parts = fit.select("_x", "copies").mapInArrow(run, RANGES)
    return collect_ranges(sum_ranges(parts, dtype=dtype), length, dtype)


def _sums(fit: DataFrame, d: int, weights: str) -> tuple[int, list[int]]:
    """(total weight, exact sum of each dimension)."""

    def fold(x, w):
        top, *rest = ((x >> bits) & (-1 if bits == _PARTS[0] else 0xFFFF) for bits in _PARTS)
        return np.concatenate([*(part.T @ w for part in (top, *rest)), [w.sum()]])

    added = _added(fit, d, len(_PARTS) * d + 1, np.int64, weights, fold)
    parts = added[:-1].reshape(len(_PARTS), d).tolist()
    return int(added[-1]), [sum(p << bits for p, bits in zip(ps, _PARTS)) for ps in zip(*parts)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x minus the mean: the whole part of the mean is taken away in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    if max((abs(s // n) for s in sums), default=0) < LIMIT >> 1 and np.abs(x).max(initial=0) < LIMIT >> 1:
        return (x - whole).astype(np.float64) - rest
    return x.astype(np.float64) - whole.astype(np.float64) - rest


def _covariance(fit: DataFrame, d: int, n: int, weights: str, values) -> np.ndarray:
    """Covariance, divisor n, of the centred rows that `values(vectors)` gives."""

    def fold(x, w):
        c = values(x)
        return ((c * w[:, None]).T @ c).ravel()

    wide = len(values(np.zeros((1, d), np.int64))[0])
    return _added(fit, d, wide * wide, np.float64, weights, fold).reshape(wide, wide) / n


def fit_whitening(fit: DataFrame, weights: str = "one", most: int = COMPONENTS) -> Whitening | None:
    """The transform of the vectors `fit` (see `distinct`), None if there are none.

    `weights` "one" counts each distinct vector once, "count" as often as it occurs. Two passes:
    exact sums, then one product of centred vectors a task; both are added up by range. Only the
    covariance, whose size is that of the vectors squared, reaches the driver. Vectors of different
    lengths raise a ValueError.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    least, longest = fit.agg(F.min(F.octet_length("_x")), F.max(F.octet_length("_x"))).first()
    if longest is None:
        return None
    if least != longest:
        raise ValueError(f"vectors of {least // 8} and of {longest // 8} entries")
    d = longest // 8
    n, sums = _sums(fit, d, weights)
    v = _covariance(fit, d, n, weights, lambda x: _centred(x, n, sums))
    values, directions = np.linalg.eigh((v + v.T) / 2)
    top = np.argsort(values, kind="stable")[::-1][:most]
    return Whitening(n, sums, np.maximum(values[top], 0.0), directions[:, top], float(np.trace(v)))


def _projected(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    good = fitted.good
    scale = np.zeros(len(good))
    scale[good] = 1 / np.sqrt(fitted.eigenvalues[good])
    return _centred(x, fitted.n, fitted.sums) @ fitted.directions * scale


def _deviations(x: np.ndarray, fitted: Whitening) -> pa.Array:
    """Sum of (n * x - S) ** 2 in exact integers; null if a long cannot hold it."""
    # Differences that fit are right even where the products wrapped around.
    n, sums = np.uint64(fitted.n), np.array([s % (1 << 64) for s in fitted.sums], np.uint64)
    apart = (x.view(np.uint64) * n - sums).view(np.int64)
    exact = (apart.view(np.uint64) ** np.uint64(2)).sum(axis=1, dtype=np.uint64).view(np.int64)
    about = ((_centred(x, fitted.n, fitted.sums) * float(fitted.n)) ** 2).sum(axis=1)
    top = float(np.iinfo(np.int64).max)
    if (about < 0.999 * top).all():
        return pa.array(exact)
    out = [
        None if size > 1.001 * top
        else int(e) if size < 0.999 * top
        else _long(sum((fitted.n * int(v) - s) ** 2 for v, s in zip(row, fitted.sums)))
        for e, size, row in zip(exact, about, x)
    ]
    return pa.array(out, pa.int64())


def _long(value: int) -> int | None:
    return value if value <= np.iinfo(np.int64).max else None


def whitened(fit: DataFrame, fitted: Whitening) -> DataFrame:
    """`(_name, deviation, whitened ARRAY<DOUBLE>)` of each distinct vector."""
    d = len(fitted.sums)
    shared = fit.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part, x, _ in _blocks(batches, d, "one"):
            z = _projected(x, known)
            flat = pa.array(z.ravel())
            if not known.good.all():
                flat = pa.array(z.ravel(), mask=np.tile(~known.good, len(z)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat)
            arrays = [part.column(part.schema.get_field_index("_name")), _deviations(x, known), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["_name", "deviation", "whitened"])

    chosen = fit.select("_name", "_x", "copies")
    return chosen.mapInArrow(run, "_name BINARY, deviation LONG, whitened ARRAY<DOUBLE>")


def identity_error(fit: DataFrame, fitted: Whitening, weights: str = "one") -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, among components that
    have variance. Measured over all of `fit` in a pass of its own."""
    d, good = len(fitted.sums), fitted.good
    k = int(good.sum())
    if not k:
        return 0.0
    mean = _added(
        fit, d, k, np.float64, weights, lambda x, w: (_projected(x, fitted)[:, good] * w[:, None]).sum(axis=0)
    ) / fitted.n
    cov = _covariance(fit, d, fitted.n, weights, lambda x: _projected(x, fitted)[:, good] - mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    most: int = COMPONENTS,
    weights: str = "one",
    hot_copies: int = HOT_COPIES,
) -> DataFrame:
    """`(id, component, n, deviation, whitened, explained, identity_error)`: up to `most` rows for
    each row of `vectors` that has a usable vector.

    Entries become whole numbers first (`whole_numbers`), so that equal vectors are grouped; each
    distinct one is whitened once and joined back by its digest. Vectors with `hot_copies` copies or
    more are looked up in place and their rows not shuffled; on large tables these are vectors that
    one in MOST_HOT rows has, so that there are no more than MOST_HOT.

    Rows without a usable vector (null, null or non-finite entries, no entries) give no rows. Rows
    that repeat, and rows with a null id, give rows each. Where all vectors agree, or along
    components without variance, `whitened` is null. `deviation` is null where it exceeds a long, and
    entries beyond 2 ** 62 / 64 count as that. An empty table gives an empty table. Vectors of
    different lengths raise a ValueError. Other columns, whatever their names, are ignored.
    """
    rows = whole_numbers(vectors.select(F.col(id).alias("_id"), F.col(vector).alias("_v")), "_v", ("_id",))
    fit = distinct(rows)
    fitted = fit_whitening(fit, weights, most)
    if fitted is None:
        fitted = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    error = identity_error(fit, fitted, weights)
    named = whitened(fit, fitted).withColumnRenamed("_name", "_of")
    total = fit.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    crowded = fit.filter(F.col("copies") >= max(hot_copies, total // MOST_HOT)).select(F.col("_name").alias("_crowded"))
    slim = rows.select("_id", "_name")
    if crowded.isEmpty():
        both = slim.join(named, F.col("_name") == F.col("_of"))
    else:
        flagged = named.join(F.broadcast(crowded), F.col("_of") == F.col("_crowded"), "left")
        marked = slim.join(F.broadcast(crowded), F.col("_name") == F.col("_crowded"), "left")
        parts = []
        for hot in (True, False):
            test = F.col("_crowded").isNotNull() if hot else F.col("_crowded").isNull()
            side = flagged.filter(test).drop("_crowded")
            parts.append(
                marked.filter(test).drop("_crowded")
                .join(F.broadcast(side) if hot else side, F.col("_name") == F.col("_of"))
            )
        both = parts[0].unionByName(parts[1])
    share = fitted.eigenvalues / fitted.trace if fitted.trace > 0 else np.zeros(len(fitted.eigenvalues))
    shares = F.array(*(F.lit(float(s)) for s in share)).cast("array<double>")
    return both.select("_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        F.col("_id").alias(id),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark, sf: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))
