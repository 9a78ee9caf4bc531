"""Full-batch training by nonlinear conjugate gradient with an exact quadratic step.

Each round makes two distributed passes: gradient (with loss), then curvature along the new
direction. What remains for the driver is arithmetic on vectors of the model's length.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from clicktide.operators.blocks import block_stats, few_tasks, pack
from clicktide.operators.objective import PACKED_MAX_DIM, PackedObjective, weights_table
from clicktide.plans.params import CGParams
from clicktide.plans.rounds import Rounds, vector_arrays, vector_ranges
from clicktide.session import cached
from clicktide.sources.blockstore import BlockStore

TRACE_SCHEMA = (
    "iter INT, loglik DOUBLE, rtime DOUBLE, alpha DOUBLE, beta DOUBLE, w_norm DOUBLE, "
    "w_diff_norm DOUBLE, w0 DOUBLE, grad_norm DOUBLE, gtd DOUBLE, uhu DOUBLE, gtold DOUBLE"
)


@dataclass
class Fit:
    """`weights(idx, w)`, the per-round `trace`, and the data size seen."""

    weights: DataFrame
    trace: DataFrame
    n: int
    d: int


def dai_yuan(
    first: bool, gtold: float, gg: float, mu_dg: float, g_old2: float, tol: float
) -> float | None:
    """Direction coefficient, or None to restart with steepest descent. May be negative."""
    if first or abs(gtold) < tol or mu_dg == 0 or g_old2 == 0:
        return None
    return gg / mu_dg


def restart_bound(params: CGParams, g_old2: float, mu2: float) -> float:
    if params.restart_relative:
        return params.restart_tol * float(np.sqrt(g_old2 * mu2))
    return params.restart_tol


def quadratic_step(gtd: float, curvature: float) -> float:
    """Minimiser of the local quadratic along the direction; 0 on zero curvature."""
    return 0.0 if curvature == 0 else -gtd / curvature


def minimise(
    objective: PackedObjective,
    start: np.ndarray,
    params: CGParams,
    rounds: int,
    n: int | None,
    anchor: np.ndarray | None = None,
    saved: Rounds | None = None,
) -> tuple[np.ndarray, list[dict]]:
    """Up to `rounds` rounds from `start` on total loss + lam/2 |w - anchor|^2 (anchor None = 0).

    `n` is the number of samples, None for that of `objective`'s own data. Returns the weights and one
    trace row per round, the last one included. With `saved`, each round is saved, and rounds saved
    before are not made again.
    """
    w = np.array(start, np.float64)
    centre = np.zeros_like(w) if anchor is None else np.array(anchor, np.float64)
    mu, g_old = np.zeros_like(w), np.zeros_like(w)
    trace = []
    if saved is not None and (last := saved.last()) is not None:
        vectors, trace = saved.load(last)
        w, mu, g_old = vector_arrays(vectors)
        if trace[-1]["w_diff_norm"] < params.eps:
            return w, trace
    for i in range(len(trace), rounds):
        began = time.monotonic()
        data_g, loss = objective.gradient(w)
        samples = max(objective.n_samples if n is None else n, 1)
        scale = float(params.scale or samples)
        g = (data_g + params.lam * (w - centre)) / scale
        gtold, g_old2 = float(g_old @ mu), float(g_old @ g_old)
        tol = restart_bound(params, g_old2, float(mu @ mu))
        beta = dai_yuan(i == 0, gtold, float(g @ g), float(mu @ (g - g_old)), g_old2, tol)
        mu = -g if beta is None else beta * mu - g
        gtd = float(mu @ g)
        uhu = (objective.curvature(w, mu) + params.lam * float(mu @ mu)) / scale
        alpha = quadratic_step(gtd, uhu)
        penalty = params.lam / 2 * float((w - centre) @ (w - centre))
        w_next = w + alpha * mu
        moved = float(np.linalg.norm(w_next - w))
        w, g_old = w_next, g
        trace.append(
            {
                "iter": i,
                "loglik": (penalty + loss) / samples,
                "rtime": time.monotonic() - began,
                "alpha": alpha,
                "beta": beta or 0.0,
                "w_norm": float(np.linalg.norm(w)),
                "w_diff_norm": moved,
                "w0": float(w[0]),
                "grad_norm": float(np.linalg.norm(g)),
                "gtd": gtd,
                "uhu": uhu,
                "gtold": gtold,
            }
        )
        if saved is not None:
            saved.save(i, vector_ranges(saved.spark, w, mu, g), trace)
        if moved < params.eps:
            break
    return w, trace


def trace_table(spark: SparkSession, rows: list[dict], schema: str = TRACE_SCHEMA) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def saved_rounds(spark: SparkSession, path: str | None, params: CGParams, n: int, d: int) -> Rounds | None:
    """Where a fit of this data and penalty saves its rounds; None without a path."""
    if path is None:
        return None
    return Rounds(spark, path, TRACE_SCHEMA, {"lam": params.lam, "scale": params.scale, "n": n, "d": d})


def train_blocks(blocks: DataFrame, n: int, d: int, params: CGParams, rounds_at: str | None = None) -> Fit:
    """`train_cg` on packed blocks of known size, which the caller keeps cached."""
    spark = blocks.sparkSession
    merged, tasks = few_tasks(blocks)
    passes = PackedObjective(merged, d, tasks)
    saved = saved_rounds(spark, rounds_at, params, n, d)
    w, rows = minimise(passes, np.zeros(d), params, params.max_iter, n, saved=saved)
    return Fit(weights_table(spark, w), trace_table(spark, rows), n, d)


def train_store(
    store: BlockStore,
    params: CGParams = CGParams(),
    method: str = "auto",
    packed_max_dim: int = PACKED_MAX_DIM,
    rounds_at: str | None = None,
) -> Fit:
    """`train_cg` on a block store: nothing before the blocks is read again, whatever is lost."""
    if method not in ("auto", "packed", "join"):
        raise ValueError("method must be 'auto', 'packed' or 'join'")
    if store.d <= 0:
        raise ValueError("no examples")
    if method == "join" or (method == "auto" and store.d > packed_max_dim):
        from clicktide.plans.cg_tables import train_cg_join

        return train_cg_join(store.blocks, params, rounds_at)
    if store.d > packed_max_dim:
        raise ValueError(f"{store.d} dimensions exceed {packed_max_dim}, use method='join'")
    with cached(store.blocks) as blocks:
        return train_blocks(blocks, store.n, store.d, params, rounds_at)


def train_cg(
    examples: DataFrame,
    params: CGParams = CGParams(),
    method: str = "auto",
    keys: Sequence[str] = ("req", "seg"),
    packed_max_dim: int = PACKED_MAX_DIM,
    rounds_at: str | None = None,
) -> Fit:
    """Fit counted examples `(keys.., pos, neg, idx)`.

    `packed` keeps the weight vector on the driver and sends it to tasks. `join` keeps weights in
    tables and examples in tiles. `auto` takes `packed` up to `packed_max_dim` dimensions; beyond, the
    packed blocks are what is cut into tiles. Nothing depends on `keys`. The trace's `loglik` is the
    mean objective at the start of each round.

    With `rounds_at`, a folder, every round is saved there, and a fit of the same data and penalty that
    was stopped goes on from its last finished round, with either method. `train_store` fits
    examples that were packed and written before.
    """
    if method not in ("auto", "packed", "join"):
        raise ValueError("method must be 'auto', 'packed' or 'join'")
    from clicktide.plans.cg_tables import train_cg_join

    if method == "join":
        return train_cg_join(examples, params, rounds_at)
    with cached(pack(examples)) as blocks:
        n, d = block_stats(blocks)
        if d <= packed_max_dim:
            return train_blocks(blocks, n, d, params, rounds_at)
        if method == "packed":
            raise ValueError(f"{d} dimensions exceed {packed_max_dim}, use method='join'")
        return train_cg_join(blocks, params, rounds_at)
