"""Examples cut into tiles, for weight vectors too long for one task.

The matrix of examples and dimensions is cut once, by blocks of rows and by ranges of dimensions, and
its tokens are shuffled once, to where the weights of their range will be sent. A pass then moves
numbers only: a range of weights to each tile that needs it, and one number for each row that a
tile has, to its block or back. Tiles and blocks are written as bucketed tables, so that a pass
reads them in place, and so does a task that runs again after its executor was lost.

    blocks  (r, pos, neg, tiles, counts, rows)   which rows of a block each of its tiles has
    tiles   (tile, key, n, r, sizes, idx)        tokens of those rows in range `key`, in that order

A tile number stands for one range of dimensions and some of the blocks; a range with more than
TILE_TOKENS tokens has several, so hot dimensions are spread over tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from clicktide.operators.blocks import read_blocks, row_sums
from clicktide.operators.reduce import RANGES, in_ranges, sum_ranges
from clicktide.session import Written, drop_path, ensure_checkpoint_dir

# Dimensions of one range: 2 MB of weights. Ranges of 32-bit dimensions number 8192 at most.
COLUMNS = 1 << 18
BLOCK_ROWS = 1 << 16
# Tokens of one range that meet its weights in one call: 16 MB. Small inputs have smaller tiles, at
# least one for each core.
TILE_TOKENS, LEAST_TOKENS = 1 << 22, 1 << 16

# Numbers that move between blocks and tiles, one for each row of block `r` in `tile`.
PARTS = "tile INT, r LONG, v BINARY"


class Bucketed:
    """A table written once, in buckets by `key`, which can be dropped."""

    def __init__(self, df: DataFrame, key: str, buckets: int):
        self._spark = df.sparkSession
        self.buckets = buckets
        self._name = f"clicktide_{uuid.uuid4().hex}"
        self._path = f"{ensure_checkpoint_dir(self._spark)}/table-{uuid.uuid4()}"
        # Rows are dealt as buckets are, so that each bucket is one file.
        dealt = df.repartition(buckets, key)
        writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key)
        writer.option("path", self._path).saveAsTable(self._name)
        self.rows = self._spark.table(self._name)

    def drop(self) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {self._name}")
        drop_path(self._spark, self._path)


def _numbers(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _row_blocks(examples: DataFrame, block_rows: int) -> DataFrame:
    """`(r, pos, neg, sizes, idx)`: blocks of about `block_rows` examples, of whole packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def told():
            columns = [np.concatenate(c) for c in zip(*held)]
            arrays = [pa.array([number], pa.int64())] + [pa.array([_binary(c)]) for c in columns]
            return pa.RecordBatch.from_arrays(arrays, ["r", "pos", "neg", "sizes", "idx"])

        for part in read_blocks(batches):
            if size and size + len(part.pos) > block_rows:
                yield told()
                number, held, size = number + 1, [], 0
            held.append(part)
            size += len(part.pos)
        if size:
            yield told()

    schema = "r LONG, pos BINARY, neg BINARY, sizes BINARY, idx BINARY"
    return examples.mapInArrow(run, schema)


def _cut(sizes: np.ndarray, idx: np.ndarray, columns: int):
    """(range, rows, tokens of each row, dimensions inside the range) for each range of a block."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    key = idx // columns
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    for k, at in zip(keys.tolist(), np.split(order, first[1:])):
        rows, n = np.unique(row[at], return_counts=True)
        yield k, rows.astype(np.int32), n.astype(np.int32), (idx[at] - k * columns).astype(np.int32)


@dataclass
class Tiles:
    """Examples in tiles. `ranges` has (key, n, first, tiles): length, first tile and number of tiles."""

    blocks: Bucketed
    tiles: Bucketed
    ranges: DataFrame
    columns: int
    n: int
    d: int

    def drop(self) -> None:
        self.blocks.drop()
        self.tiles.drop()

    # --- passes ---

    def at_tiles(self, vectors: DataFrame) -> DataFrame:
        """`PARTS`: what each tile adds to the margins of its rows. `vectors (key, first, tiles, v)`."""
        last = F.col("first") + F.col("tiles") - 1
        sent = vectors.select(F.explode(F.sequence("first", last)).alias("tile"), "v")

        def multiply(tiles: pa.Table, vector: pa.Table) -> pa.Table:
            out = []
            for batch in tiles.to_batches():
                number, _, _, r, sizes, idx = batch.columns
                w = _numbers(vector.column("v")[0], np.float64)
                out += [
                    (number[i].as_py(), r[i].as_py(), _binary(row_sums(w[_numbers(idx[i], np.int32)], _numbers(sizes[i], np.int32))))
                    for i in range(batch.num_rows)
                ]
            return _parts(out)

        return self.tiles.rows.groupBy("tile").cogroup(sent.groupBy("tile")).applyInArrow(multiply, PARTS)

    def at_blocks(self, parts: DataFrame, state: DataFrame | None, fold, schema: str) -> DataFrame:
        """`fold(pos, neg, sums, state row)` of each block, where `sums` adds up `parts` by row.

        `fold` gives the values of `schema` behind `r`; `state (r, z, xm)` has a row for each block.
        """
        sent = parts.select("r", "tile", "v", F.lit(None).cast("binary").alias("xm"))
        if state is not None:
            sent = sent.unionByName(state.select("r", F.lit(-1).alias("tile"), F.col("z").alias("v"), "xm"))
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = {"BINARY": pa.binary(), "DOUBLE": pa.float64()}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]

        def add(blocks: pa.Table, given: pa.Table) -> pa.Table:
            block = {c: blocks.column(c)[0] for c in blocks.column_names}
            pos, neg = _numbers(block["pos"], np.float64), _numbers(block["neg"], np.float64)
            rows = dict(_rows_of(block))
            sums, known = np.zeros(len(pos)), {}
            # In the order of tiles, so that reruns add alike.
            for i in np.argsort(given.column("tile").to_numpy(), kind="stable").tolist():
                tile, v = given.column("tile")[i].as_py(), _numbers(given.column("v")[i], np.float64)
                if tile < 0:
                    known = {"z": v, "xm": _numbers(given.column("xm")[i], np.float64)}
                else:
                    sums[rows[tile]] += v
            values = fold(pos, neg, sums, known)
            arrays = [pa.array([block["r"].as_py()], pa.int64())]
            arrays += [pa.array([_binary(v) if t == pa.binary() else v], t) for v, t in zip(values, types)]
            return pa.Table.from_arrays(arrays, ["r", *names])

        both = self.blocks.rows.groupBy("r").cogroup(sent.groupBy("r"))
        return both.applyInArrow(add, f"r LONG, {schema}")

    def to_tiles(self, state: DataFrame, value) -> DataFrame:
        """`PARTS`: `value(pos, neg, z, xm)` of a block's rows, for each of its tiles."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                for i in range(batch.num_rows):
                    block = {c: batch.column(k)[i] for k, c in enumerate(names)}
                    args = (_numbers(block[c], np.float64) for c in ("pos", "neg", "z", "xm"))
                    v = value(*args)
                    r = block["r"].as_py()
                    yield from _parts([(t, r, _binary(v[rows])) for t, rows in _rows_of(block)]).to_batches()

        given = state.select(F.col("r").alias("_r"), "z", "xm")
        both = self.blocks.rows.join(given, F.col("r") == F.col("_r")).drop("_r")
        return both.mapInArrow(run, PARTS)

    def transposed(self, parts: DataFrame) -> DataFrame:
        """Rows `RANGES` of the ranges' sums over all rows, from one number for each row of a tile."""

        def multiply(tiles: pa.Table, given: pa.Table) -> pa.Table:
            whose = dict(zip(given.column("r").to_pylist(), given.column("v")))
            total = None
            for batch in tiles.to_batches():
                _, key, n, r, sizes, idx = batch.columns
                for i in range(batch.num_rows):
                    if total is None:
                        number, total = key[i].as_py(), np.zeros(n[i].as_py())
                    v = np.repeat(_numbers(whose[r[i].as_py()], np.float64), _numbers(sizes[i], np.int32))
                    at = _numbers(idx[i], np.int32)
                    if 4 * len(at) > len(total):
                        total += np.bincount(at, weights=v, minlength=len(total))
                    else:
                        np.add.at(total, at, v)
            (row,) = in_ranges(total, len(total)) if total.any() else [None]
            if row is None:
                return pa.Table.from_batches([], pa.schema([("key", pa.int32()), ("n", pa.int32()), ("at", pa.binary()), ("v", pa.binary())]))
            return pa.Table.from_batches([row.set_column(0, "key", pa.array([number], pa.int32()))])

        both = self.tiles.rows.groupBy("tile").cogroup(parts.groupBy("tile"))
        return sum_ranges(both.applyInArrow(multiply, RANGES), self.tiles.buckets)


def _parts(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[], [], []]
    kinds = [pa.int32(), pa.int64(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["tile", "r", "v"])


def _rows_of(block: dict) -> list[tuple[int, np.ndarray]]:
    """(tile, rows of it) of a block."""
    counts = _numbers(block["counts"], np.int32)
    rows = np.split(_numbers(block["rows"], np.int32), np.cumsum(counts)[:-1])
    return list(zip(_numbers(block["tiles"], np.int32).tolist(), rows)) if len(counts) else []


def in_tiles(
    examples: DataFrame,
    d: int | None = None,
    columns: int = COLUMNS,
    block_rows: int = BLOCK_ROWS,
    tile_tokens: int = TILE_TOKENS,
) -> Tiles:
    """`examples (pos, neg, idx)`, as rows or packed, in tiles: their tokens are shuffled once.

    `d` is the length of weight vectors, by default the highest dimension + 1. Examples without
    dimensions have a margin of zero, NULL lists count as empty. Without `d`, there must be a token.
    """
    spark = examples.sparkSession
    if "sizes" in examples.columns:
        clean = examples.select("pos", "neg", "sizes", "idx")
    else:
        none = F.array().cast("array<int>")
        clean = examples.select("pos", "neg", F.coalesce("idx", none).cast("array<int>").alias("idx"))
    raw = Written(_row_blocks(clean, block_rows))
    try:
        return _cut_tiles(spark, raw.rows, d, columns, tile_tokens)
    finally:
        raw.drop()


def _cut_tiles(spark: SparkSession, raw: DataFrame, d, columns: int, tile_tokens: int) -> Tiles:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, pos, neg, _, idx = batch.columns
            for i in range(batch.num_rows):
                keys, n = np.unique(_numbers(idx[i], np.int32) // columns, return_counts=True)
                total = float(_numbers(pos[i], np.float64).sum() + _numbers(neg[i], np.float64).sum())
                top = int(_numbers(idx[i], np.int32).max(initial=-1))
                arrays = [
                    pa.array(np.append(keys, -1), pa.int32()), pa.array(np.append(n, 1), pa.int64()),
                    pa.array([0.0] * len(keys) + [total]), pa.array([top] * (len(keys) + 1), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "tokens", "samples", "top"])

    # One row for each range, and -1 for the blocks themselves.
    seen = raw.mapInArrow(count, "key INT, tokens LONG, samples DOUBLE, top INT").groupBy("key").agg(
        F.sum("tokens").alias("tokens"), F.sum("samples").alias("samples"), F.max("top").alias("top")
    )
    found = {r.key: r for r in seen.collect()}
    whole = found.get(-1)
    top = whole.top if whole else -1
    if d is None and top < 0:
        raise ValueError("no examples")
    d = top + 1 if d is None else d
    if top >= d:
        raise ValueError(f"dimension {top} is beyond {d}")
    n_ranges = max(1, -(-d // columns))
    tokens = [found[k].tokens if k in found else 0 for k in range(n_ranges)]
    each = min(tile_tokens, max(LEAST_TOKENS, sum(tokens) // spark.sparkContext.defaultParallelism))
    tiles = [max(1, -(-t // each)) for t in tokens]
    first = np.concatenate([[0], np.cumsum(tiles)]).tolist()
    lengths = [min(columns, d - k * columns) for k in range(n_ranges)]
    rows = [(k, lengths[k], first[k], tiles[k]) for k in range(n_ranges)]
    ranges = spark.createDataFrame(rows, "key INT, n INT, first INT, tiles INT")

    def number(k: int, r: int) -> int:
        # Blocks of all partitions are dealt evenly.
        return first[k] + ((r >> 32) * 31 + (r & 0xFFFFFFFF)) % tiles[k]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, _, _, sizes, idx = batch.columns
            for i in range(batch.num_rows):
                block = r[i].as_py()
                for k, _, n, at in _cut(_numbers(sizes[i], np.int32), _numbers(idx[i], np.int32), columns):
                    row = [number(k, block), k, lengths[k], block, _binary(n), _binary(at)]
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(row, kinds)], ["tile", "key", "n", "r", "sizes", "idx"]
                    )

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, pos, neg, sizes, idx = batch.columns
            for i in range(batch.num_rows):
                block = r[i].as_py()
                cuts = [(number(k, block), rows) for k, rows, _, _ in _cut(_numbers(sizes[i], np.int32), _numbers(idx[i], np.int32), columns)]
                kept = np.concatenate([np.zeros(0, np.int32)] + [rows for _, rows in cuts])
                values = [
                    _binary(np.array([t for t, _ in cuts], np.int32)),
                    _binary(np.array([len(rows) for _, rows in cuts], np.int32)), _binary(kept),
                ]
                arrays = [batch.column(k).slice(i, 1) for k in range(3)] + [pa.array([v]) for v in values]
                yield pa.RecordBatch.from_arrays(arrays, ["r", "pos", "neg", "tiles", "counts", "rows"])

    # Buckets are no fewer than the session's shuffle partitions, or Spark would deal them anew.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks, n_tiles = whole.tokens if whole else 0, first[-1]
    side = Bucketed(raw.mapInArrow(sides, "r LONG, pos BINARY, neg BINARY, tiles BINARY, counts BINARY, rows BINARY"), "r", max(least, min(n_blocks, 1 << 14)))
    schema = "tile INT, key INT, n INT, r LONG, sizes BINARY, idx BINARY"
    body = Bucketed(raw.mapInArrow(cut, schema), "tile", max(least, min(n_tiles, 1 << 14)))
    return Tiles(side, body, ranges, columns, int(whole.samples) if whole else 0, d)
