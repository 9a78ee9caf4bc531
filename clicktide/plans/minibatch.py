"""Mini-batch training: conjugate gradient on one batch after another, weights averaged."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from clicktide.operators.batches import batch_count
from clicktide.operators.blocks import few_tasks
from clicktide.operators.objective import PACKED_MAX_DIM, PackedObjective, weights_table
from clicktide.operators.tiles import Tiles, in_tiles
from clicktide.plans.cg import TRACE_SCHEMA, Fit, minimise, trace_table
from clicktide.plans.cg_tables import (
    VECTORS,
    minimise_tables,
    mixed,
    total_loss,
    weight_rows,
    zero_state,
)
from clicktide.plans.params import CGParams
from clicktide.session import Written, cached, ensure_checkpoint_dir
from clicktide.sources.blockstore import BlockStore, write_store

BATCH_TRACE_SCHEMA = "pass INT, batch INT, " + TRACE_SCHEMA + ", avg_objective DOUBLE"

# Rows of one batch that share a task before the batch is spread over more tasks.
ROWS_PER_PIECE = 1_000_000

# Trace rows held on the driver before they are written out.
TRACE_ROWS = 10_000


class _Trace:
    """Trace rows, moved to a table whenever there are many."""

    def __init__(self, spark):
        self._spark, self._rows, self._tables = spark, [], []

    def add(self, rounds: list[dict], sweep: int, batch: int, value: float | None) -> None:
        self._rows += [{**r, "pass": sweep, "batch": batch, "avg_objective": value} for r in rounds]
        if len(self._rows) >= TRACE_ROWS:
            self._tables.append(Written(self._table()).rows)
            self._rows = []

    def _table(self) -> DataFrame:
        return trace_table(self._spark, self._rows, BATCH_TRACE_SCHEMA)

    def table(self) -> DataFrame:
        all_rows = self._table()
        for part in self._tables:
            all_rows = all_rows.unionByName(part)
        return all_rows


def train_cg_minibatch(
    examples: DataFrame,
    params: CGParams = CGParams(),
    keys: Sequence[str] = ("req", "seg"),
    seed: int = 0,
    anchor: str = "previous",
    batch: Column | None = None,
    n_batches: int | None = None,
    track_objective: bool = True,
    method: str = "auto",
    packed_max_dim: int = PACKED_MAX_DIM,
) -> Fit:
    """`params.max_iter` passes over all batches, `params.inner_iter` rounds on each.

    Each batch starts from the weights of the one before. `anchor="previous"` penalises the
    distance to those, `anchor="zero"` the weights themselves. The result is the mean of the
    weights after each batch. `avg_objective` is `(lam/2 |a|^2 + total loss(a)) / n` over all
    examples for the mean `a` so far; it costs one full pass per batch. The trace's `loglik` is the
    mean objective of the batch, and `rtime` the seconds of the round.

    Batches come from a seeded hash of each row's place in the input, or from `batch` with numbers in
    [0, `n_batches`); nothing depends on `keys`. They are written once, each to files of its own
    (`sources.blockstore`), so that a batch starts its own tasks only. On large data give `n_batches`:
    batches follow each other, so their number sets the time.
    `packed` keeps weights on the driver, `join` in tables, `auto` takes `packed` up to
    `packed_max_dim` dimensions; the result does not depend on it.
    """
    if anchor not in ("previous", "zero"):
        raise ValueError("anchor must be 'previous' or 'zero'")
    if method not in ("auto", "packed", "join"):
        raise ValueError("method must be 'auto', 'packed' or 'join'")
    rows, n, d = examples.agg(
        F.count("*"), F.sum(F.col("pos") + F.col("neg")), F.max(F.array_max("idx")) + 1
    ).first()
    if d is None:
        raise ValueError("no examples")
    if method == "packed" and d > packed_max_dim:
        raise ValueError(f"{d} dimensions exceed {packed_max_dim}, use method='join'")
    if n_batches is None:
        n_batches = batch_count(int(n), params.batch_size)
    largest = rows // n_batches
    if batch is not None:
        largest = examples.groupBy(batch.alias("batch")).count().agg(F.max("count")).first()[0]
    spark = examples.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4()}"
    store = write_store(examples, place, n_batches, batch, seed, largest // ROWS_PER_PIECE + 1)
    try:
        if method == "join" or d > packed_max_dim:
            return _in_tables(store, params, n_batches, anchor, track_objective, int(n), int(d))
        return _packed(store, params, n_batches, anchor, track_objective, int(n), int(d))
    finally:
        store.drop()


def _packed(
    store: BlockStore, params: CGParams, n_batches: int, anchor: str, track_objective: bool, n: int, d: int
) -> Fit:
    """Weights on the driver; a batch's passes run in the tasks of its own files only."""
    spark = store.blocks.sparkSession
    whole = PackedObjective(store.blocks.drop("batch"), d) if track_objective else None
    w, total, done, trace = np.zeros(d), np.zeros(d), 0, _Trace(spark)
    for sweep in range(params.max_iter):
        for b in range(n_batches):
            with cached(store.batch(b)) as blocks:
                merged, tasks = few_tasks(blocks)
                part = PackedObjective(merged, d, tasks)
                w, rounds = minimise(
                    part, w, params, params.inner_iter, None, w if anchor == "previous" else None
                )
            total, done = total + w, done + 1
            average = total / done
            value = None
            if whole is not None:
                value = (params.lam / 2 * float(average @ average) + whole.loss(average)) / n
            trace.add(rounds, sweep, b, value)
    return Fit(weights_table(spark, total / max(done, 1)), trace.table(), n, d)


def _in_tables(
    store: BlockStore, params: CGParams, n_batches: int, anchor: str, track_objective: bool, n: int, d: int
) -> Fit:
    """The same with weights, their sum and all vectors of a round in tables."""
    spark = store.blocks.sparkSession
    parts: dict[int, Tiles] = {}
    whole = in_tiles(store.blocks, d)
    trace, done = _Trace(spark), 0
    w, total = Written(zero_state(whole)), Written(zero_state(whole))
    try:
        for sweep in range(params.max_iter):
            for b in range(n_batches):
                if b not in parts:
                    parts[b] = in_tiles(store.batch(b), d)
                # Tiles number their own ranges.
                start = parts[b].ranges.join(w.rows.select("key", *VECTORS), "key")
                after, rounds = minimise_tables(parts[b], start, params, params.inner_iter, anchor == "previous")
                done += 1
                summed = Written(mixed(total.rows, after.rows, 1.0, 1.0))
                w.drop()
                total.drop()
                w, total = after, summed
                value = None
                if track_objective:
                    mean = mixed(total.rows, total.rows, 1 / done, 0.0)
                    loss = total_loss(whole, whole.ranges.join(mean.select("key", *VECTORS), "key"))
                    square = weight_rows(mean, whole.columns).agg(F.sum(F.col("w") * F.col("w"))).first()[0]
                    value = (params.lam / 2 * (square or 0.0) + loss) / n
                trace.add(rounds, sweep, b, value)
        mean = mixed(total.rows, total.rows, 1 / max(done, 1), 0.0)
        return Fit(weight_rows(mean, whole.columns), trace.table(), n, d)
    finally:
        w.drop()
        for tiles in (whole, *parts.values()):
            tiles.drop()
