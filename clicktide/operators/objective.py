"""Loss, gradient and curvature of logistic regression over counted examples.

Two forms with one meaning. The join form below works on tables only, whatever the number of
dimensions. The packed form sends the weight vector to every task and is the fast one while a
vector fits there. Penalty terms are added by the trainer, not here.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clicktide.functions.scalar import (
    counted_curvature,
    counted_loss,
    counted_residual,
)
from clicktide.operators.blocks import (
    Block,
    block_loss,
    clip,
    logistic,
    padded,
    read_blocks,
    row_sums,
)
from clicktide.operators.encode import HEAD_DIMS
from clicktide.operators.reduce import RANGES, collect_ranges, in_ranges, range_entries, sum_ranges
from clicktide.session import materialise

# Longest weight vector that travels to tasks and driver: 80 MB of doubles.
PACKED_MAX_DIM = 10_000_000


# --- weight vectors and tables ------------------------------------------------------------


def weights_table(spark: SparkSession, w: np.ndarray, name: str = "w") -> DataFrame:
    """`(idx, <name>)` with one row per dimension."""
    table = pa.table({"idx": np.arange(len(w), dtype=np.int32), name: np.asarray(w, np.float64)})
    return spark.createDataFrame(table)


def weights_vector(weights: DataFrame, name: str = "w", max_dim: int = PACKED_MAX_DIM) -> np.ndarray:
    """The vector behind `(idx, <name>)`; dimensions without a row are zero."""
    top = weights.agg(F.max("idx")).first()[0]
    d = 0 if top is None else int(top) + 1
    if d > max_dim:
        raise ValueError(f"{d} dimensions exceed {max_dim}, use the join form")
    return collect_vector(weights.select("idx", F.col(name).alias("v")), d)


def collect_vector(entries: DataFrame, d: int) -> np.ndarray:
    """Rows `(idx, v)` with unique `idx` < d as a dense vector."""
    table = entries.toArrow()
    out = np.zeros(d)
    out[table.column("idx").to_numpy()] = table.column("v").to_numpy()
    return out


# --- join form ----------------------------------------------------------------------------

# Rows that a task joins and sorts, where rows meet the sums over their dimensions.
PART_ROWS = 1 << 20


def with_rows(examples: DataFrame) -> DataFrame:
    """`examples` with `_row`, a number of each row that is written once and so never changes."""
    return materialise(examples.withColumn("_row", F.monotonically_increasing_id()))


def frequent_dims(examples: DataFrame, most: int = HEAD_DIMS) -> DataFrame:
    """`(idx)`: at most `most` dimensions, among them all that more than 1 / `most` of tokens have."""
    counts = examples.select(F.explode("idx").alias("idx")).groupBy("idx").agg(F.count("*").alias("n"))
    counts = materialise(counts)
    size = counts.count()
    if size <= most:
        return counts.select("idx")
    # Of dimensions with a share above 1 / most there are fewer than `most`.
    total = counts.agg(F.sum("n")).first()[0]
    return counts.filter(F.col("n") > total / max(most, 1)).select("idx")


def margins_join(
    examples: DataFrame,
    weights: DataFrame,
    keys: Sequence[str] = ("req", "seg"),
    sums: Mapping[str, str] | None = None,
    head_dims: int = HEAD_DIMS,
    head: DataFrame | None = None,
) -> DataFrame:
    """`(keys.., pos, neg, _row, z)`: sum of weights over the active dimensions of each example.

    `sums` maps weight columns to result columns, `{"w": "z"}` unless given. Dimensions without a
    weight count as zero, and so does an example without dimensions. Examples are told apart by
    `_row` of `with_rows`, which is added if they lack it; `keys` are carried and may be NULL or
    repeat. Frequent dimensions (`head`, or `frequent_dims` of the examples) are broadcast; the
    shuffle by dimension moves the others only.
    """
    sums = dict(sums or {"w": "z"})
    if "_row" not in examples.columns:
        examples = with_rows(examples)
    carried = list(dict.fromkeys([*keys, "pos", "neg", "_row"]))
    hot = (frequent_dims(examples, head_dims) if head is None else head).select(F.col("idx").alias("_hot"))
    table = weights.select("idx", *sums).join(
        F.broadcast(hot), F.col("idx") == F.col("_hot"), "left"
    )
    near = _head_sums(examples.select(*carried, "idx"), table.filter("_hot is not null"), hot, sums)
    rare = table.filter("_hot is null").drop("_hot")
    long = near.select("_row", F.explode("_rest").alias("_idx"))
    # Rows meet in parts of bounded size, whatever the session's number of shuffle partitions.
    context = examples.sparkSession.sparkContext
    parts = max(context.defaultParallelism, -(-examples.count() // PART_ROWS))
    t = long.join(rare, F.col("_idx") == F.col("idx")).repartition(parts, "_row").groupBy("_row").agg(
        *(F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(f"_t_{out}") for c, out in sums.items())
    ).withColumnRenamed("_row", "_t")
    both = near.drop("_rest").repartition(parts, "_row").join(t, F.col("_row") == F.col("_t"), "left")
    return both.select(
        *carried,
        *((F.col(f"_h_{out}") + F.coalesce(F.col(f"_t_{out}"), F.lit(0.0))).alias(out) for out in sums.values()),
    )


def _head_sums(
    rows: DataFrame, weights: DataFrame, head: DataFrame, sums: Mapping[str, str]
) -> DataFrame:
    """`rows` with the sums of `weights` over the dimensions of `head` as `_h_<result>`, and their other
    dimensions as `_rest` for `idx`. Looked up in place: no row is shuffled, nor a frequent dimension."""
    hot = np.unique(head.toArrow().column(0).drop_null().to_numpy())
    vectors = {out: np.zeros(len(hot) + 1) for out in sums.values()}
    known = weights.select("idx", *sums).toArrow()
    at = np.searchsorted(hot, known.column("idx").to_numpy())
    for c, out in sums.items():
        # A dimension may have several weights; NULL ones are zero.
        np.add.at(vectors[out], at, known.column(c).cast(pa.float64()).fill_null(0.0).to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((hot, vectors))
    carried = [f for f in rows.schema.fields if f.name != "idx"]
    added = [T.StructField(f"_h_{out}", T.DoubleType()) for out in sums.values()]
    schema = T.StructType([*carried, *added, T.StructField("_rest", rows.schema["idx"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, vectors = shared.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("idx"))
            n = len(lists)
            row, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            if flat.null_count:
                row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
            idx = flat.to_numpy()
            at = np.searchsorted(hot, idx)
            if len(hot):
                at[hot[np.minimum(at, len(hot) - 1)] != idx] = len(hot)
            rest = at == len(hot)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in carried]
            arrays += [pa.array(np.bincount(row, weights=v[at], minlength=n), pa.float64()) for v in vectors.values()]
            starts = np.append(0, np.cumsum(np.bincount(row[rest], minlength=n))).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(idx[rest])))
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def loss_join(margins: DataFrame) -> DataFrame:
    """One row: total log loss over `(pos, neg, z)`."""
    return margins.agg(F.sum(counted_loss(F.col("pos"), F.col("neg"), F.col("z"))).alias("loss"))


def gradient_join(examples: DataFrame, margins: DataFrame) -> DataFrame:
    """`(idx, g)`: gradient of the total log loss, from margins of the same examples.

    Both sides have `_row`, see `with_rows`.
    """
    residual = counted_residual(F.col("pos"), F.col("neg"), F.col("z")).alias("r")
    rows = examples.select("_row", "idx").join(margins.select("_row", residual), "_row")
    return rows.select(F.explode("idx").alias("idx"), "r").groupBy("idx").agg(F.sum("r").alias("g"))


def curvature_join(margins: DataFrame) -> DataFrame:
    """One row: second derivative along a direction whose margins are in `xm`."""
    h = counted_curvature(F.col("pos"), F.col("neg"), F.col("z"))
    return margins.agg(F.sum(h * F.col("xm") * F.col("xm")).alias("curvature"))


# --- packed form --------------------------------------------------------------------------

# Up to this many partial gradient entries are added up on the driver, which saves a shuffle.
DIRECT_ENTRIES = 1_000_000

# Under these indices a gradient pass also carries the total loss and the number of samples.
LOSS_ROW, COUNT_ROW = -1, -2


def _entries(idx: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(idx, pa.int32()), pa.array(v, pa.float64())], ["idx", "v"]
    )


def _bend(block: Block, z: np.ndarray, xm: np.ndarray) -> float:
    s = logistic(z)
    return float(((block.pos + block.neg) * s * (1 - s)) @ (xm * xm))


class PackedObjective:
    """Passes over `data` (packed blocks, or example rows) for weight vectors of length `d`.

    Every pass is one Spark job: tasks fold their blocks, and their partial gradients are added up
    by index range, in levels. If `data` is known to run in `tasks` tasks and these send few entries
    in total, the driver adds them up itself.
    """

    def __init__(self, data: DataFrame, d: int, tasks: int | None = None):
        if d > PACKED_MAX_DIM:
            raise ValueError(f"{d} dimensions exceed {PACKED_MAX_DIM}, use the join form")
        self._context = data.sparkSession.sparkContext
        packed = [c for c in ("sizes",) if c in data.columns]
        self.data = data.select("pos", "neg", *packed, "idx")
        self.d = d
        self.n_samples = 0.0
        self.tasks = tasks
        self.direct = tasks is not None and tasks * (d + 1) <= DIRECT_ENTRIES

    def gradient_rows(self, vector) -> DataFrame:
        """`(idx, v)`: gradient entries other than zero, and loss and samples under `LOSS_ROW` and
        `COUNT_ROW`. `vector` is a broadcast weight vector."""
        beyond = F.when(F.col("idx") == self.d, LOSS_ROW).when(F.col("idx") > self.d, COUNT_ROW)
        idx = F.coalesce(beyond, F.col("idx")).cast("int").alias("idx")
        return range_entries(self._summed(vector)).select(idx, "v")

    def _summed(self, vector) -> DataFrame:
        return sum_ranges(self._partials(vector), self.tasks)

    def _partials(self, vector) -> DataFrame:
        """Ranges of each task's gradient, with its loss and samples behind the last dimension."""
        d = self.d

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, g, loss, count = padded(vector.value), np.zeros(d + 1), 0.0, 0.0
            for block in read_blocks(batches):
                idx = clip(block.idx, d)
                z = row_sums(w[idx], block.sizes)
                s = logistic(z)
                r = np.repeat((block.pos + block.neg) * s - block.pos, block.sizes)
                if d < 4 * len(idx):
                    g += np.bincount(idx, weights=r, minlength=d + 1)
                else:
                    np.add.at(g, idx, r)
                loss += block_loss(block, z)
                count += float(block.pos.sum() + block.neg.sum())
            yield from in_ranges(np.append(g[:d], [loss, count]))

        return self.data.mapInArrow(fold, RANGES)

    def gradient(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """(gradient, total loss) at `w` in one pass, which also sets `n_samples`."""
        vector = self._context.broadcast(np.asarray(w, np.float64))
        try:
            rows = self._partials(vector) if self.direct else self._summed(vector)
            g = collect_ranges(rows, self.d + 2)
        finally:
            vector.destroy()
        self.n_samples = float(g[self.d + 1])
        return g[: self.d], float(g[self.d])

    def _totals(self, fold, shared) -> DataFrame:
        """`(idx, v)`: the sum of `fold` over each task's blocks. `shared` is a broadcast of vectors."""
        d = self.d

        def one_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = [padded(v) for v in shared.value]
            total = 0.0
            for block in read_blocks(batches):
                idx = clip(block.idx, d)
                total += fold(block, *(row_sums(v[idx], block.sizes) for v in values))
            yield _entries(np.array([0]), np.array([total]))

        return self.data.mapInArrow(one_row, "idx INT, v DOUBLE")

    def _total(self, fold, *vectors: np.ndarray) -> float:
        shared = self._context.broadcast(tuple(np.asarray(v, np.float64) for v in vectors))
        try:
            # One number per task: adding them up here needs no second stage.
            return float(self._totals(fold, shared).toArrow().column("v").to_numpy().sum())
        finally:
            shared.destroy()

    def curvature_row(self, vectors) -> DataFrame:
        """`(curvature)` as one row. `vectors` is a broadcast of weights and direction."""
        return self._totals(_bend, vectors).agg(F.sum("v").alias("curvature"))

    def curvature(self, w: np.ndarray, mu: np.ndarray) -> float:
        """Second derivative of the total loss at `w` along `mu`."""
        return self._total(_bend, w, mu)

    def loss(self, w: np.ndarray) -> float:
        """Total log loss at `w`."""
        return self._total(block_loss, w)


def with_margin(examples: DataFrame, w: np.ndarray) -> DataFrame:
    """Replaces `idx` by the margin `z` = sum of `w` over it; dimensions beyond `w` are skipped.

    Takes example rows (other columns pass through) or packed blocks (yields `pos, neg, z`).
    Narrow: the vector is broadcast.
    """
    d = len(w)
    if d > PACKED_MAX_DIM:
        raise ValueError(f"{d} dimensions exceed {PACKED_MAX_DIM}, use margins_join")
    vector = examples.sparkSession.sparkContext.broadcast(np.asarray(w, np.float64))

    if "sizes" in examples.columns:

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = padded(vector.value)
            for block in read_blocks(batches):
                z = row_sums(weights[clip(block.idx, d)], block.sizes)
                arrays = [pa.array(a, pa.float64()) for a in (block.pos, block.neg, z)]
                yield pa.RecordBatch.from_arrays(arrays, ["pos", "neg", "z"])

        packed = examples.select("pos", "neg", "sizes", "idx")
        return packed.mapInArrow(unpack, "pos DOUBLE, neg DOUBLE, z DOUBLE")

    keep = [f for f in examples.schema.fields if f.name != "idx"]
    schema = examples.select(*(f.name for f in keep), F.lit(0.0).alias("z")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = padded(vector.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("idx"))
            sizes = np.diff(lists.offsets.to_numpy())
            idx = lists.flatten().to_numpy(zero_copy_only=False)
            z = row_sums(weights[clip(idx, d)], sizes)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(z, pa.float64())], [*(f.name for f in keep), "z"]
            )

    return examples.mapInArrow(rows, schema)
