"""Conjugate gradient with weights, direction and gradient kept in tables.

For models too long for one array. Examples lie in tiles (`operators.tiles`), weights in ranges of
dimensions, margins in blocks of rows. A round sends residuals to the tiles and ranges of the
direction to the tiles; tokens stay where they are. Margins are carried along: after a step z
becomes z + alpha * (x . mu). Every round ends in written tables, which keeps plans flat and survives
lost executors; tables of earlier rounds are dropped as soon as the next ones are written.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clicktide.operators.blocks import Block, block_loss, logistic
from clicktide.operators.tiles import Tiles, in_tiles
from clicktide.plans.cg import (
    Fit,
    dai_yuan,
    quadratic_step,
    restart_bound,
    saved_rounds,
    trace_table,
)
from clicktide.plans.params import CGParams
from clicktide.plans.rounds import VECTORS_SCHEMA, Rounds
from clicktide.session import Written

VECTORS = ("w", "centre", "mu", "g")
_STATE = "key INT, n INT, first INT, tiles INT, " + ", ".join(f"{v} BINARY" for v in VECTORS)
# Sums over a range, of which the numbers of a round are made.
_SUMS = ("gtold", "g_old2", "old_mu2", "gg", "mu_g", "ww", "off2", "w_mu", "w_g", "w0", "mu0", "g0")


def _vector(cell, n: int) -> np.ndarray:
    """A range of doubles; a missing one is zero."""
    return np.zeros(n) if not cell.is_valid else np.frombuffer(cell.as_buffer(), np.float64)


def _spread(at, v, n: int) -> np.ndarray:
    out = np.zeros(n)
    if v.is_valid:
        values, places = np.frombuffer(v.as_buffer(), np.float64), np.frombuffer(at.as_buffer(), np.int32)
        if len(values) == n:
            out += values
        else:
            out[places] = values
    return out


def _advanced(w, mu, g, beta: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights after the step, direction of the step) from what a round has written."""
    turned = beta * mu - g
    return w + alpha * turned, turned


def zero_state(tiles: Tiles) -> DataFrame:
    """The state of weights that are zero; NULL vectors stand for zeros."""
    return tiles.ranges.select("*", *(F.lit(None).cast("binary").alias(v) for v in VECTORS))


def _mapped(state: DataFrame, schema: str, function, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `schema`, by `function(n, vectors, other cells)` for each range of `state`."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"INT": pa.int32(), "BINARY": pa.binary(), "DOUBLE": pa.float64()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cells = {c: batch.column(k)[i] for k, c in enumerate(batch.schema.names)}
                n = cells["n"].as_py()
                vectors = {v: _vector(cells[v], n) for v in VECTORS}
                out = function(n, vectors, cells)
                kept = [out[c] if c in out else cells[c].as_py() for c in names]
                kept = [np.ascontiguousarray(v).tobytes() if isinstance(v, np.ndarray) else v for v in kept]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(kept, types)], names)

    return state.select(*(c.split()[0] for c in _STATE.split(", ")), *more).mapInArrow(run, schema)


def _turn(state: DataFrame, data_g: DataFrame, beta: float, alpha: float, lam: float, scale: float) -> DataFrame:
    """The state a step further, with the gradient there and the sums of `_SUMS`."""

    def one(n, v, cells):
        w, mu = _advanced(v["w"], v["mu"], v["g"], beta, alpha)
        g_old, off = v["g"], w - v["centre"]
        g = (_spread(cells["at"], cells["v"], n) + lam * off) / scale
        first = cells["key"].as_py() == 0 and n > 0
        sums = {
            "gtold": g_old @ mu, "g_old2": g_old @ g_old, "old_mu2": mu @ mu, "gg": g @ g, "mu_g": mu @ g,
            "ww": w @ w, "off2": off @ off, "w_mu": w @ mu, "w_g": w @ g,
            "w0": w[0] if first else 0.0, "mu0": mu[0] if first else 0.0, "g0": g[0] if first else 0.0,
        }
        return {"w": w, "mu": mu, "g": g, **{c: float(x) for c, x in sums.items()}}

    added = data_g.select(F.col("key").alias("_key"), "at", "v")
    both = state.join(added, F.col("key") == F.col("_key"), "left")
    return _mapped(both, _STATE + ", " + ", ".join(f"{s} DOUBLE" for s in _SUMS), one, ("at", "v"))


def _direction(state: DataFrame, beta: float) -> DataFrame:
    return _mapped(
        state, "key INT, first INT, tiles INT, v BINARY",
        lambda n, v, cells: {"v": _advanced(v["w"], v["mu"], v["g"], beta, 0.0)[1]},
    )


def _weights(state: DataFrame) -> DataFrame:
    return _mapped(state, "key INT, first INT, tiles INT, v BINARY", lambda n, v, cells: {"v": v["w"]})


def _residual(step: float):
    def value(pos, neg, z, xm):
        return (pos + neg) * logistic(z + step * xm) - pos

    return value


def _along(step: float):
    """Margins after the step, margins along the direction, curvature and loss of a block."""

    def fold(pos, neg, xm, known):
        z = known["z"] + step * known["xm"]
        s = logistic(z)
        bend = float(((pos + neg) * s * (1 - s)) @ (xm * xm))
        return z, xm, bend, block_loss(Block(pos, neg, None, None), z)

    return fold


def _at_start(pos, neg, z, known):
    return z, np.zeros(len(z)), 0.0, block_loss(Block(pos, neg, None, None), z)


_MARGINS = "z BINARY, xm BINARY, curvature DOUBLE, loss DOUBLE"


def total_loss(tiles: Tiles, state: DataFrame) -> float:
    """Total log loss at the weights `w` of `state`, in one pass."""
    rows = tiles.at_blocks(tiles.at_tiles(_weights(state)), None, _at_start, _MARGINS)
    return rows.agg(F.coalesce(F.sum("loss"), F.lit(0.0))).first()[0]


def minimise_tables(
    tiles: Tiles,
    start: DataFrame,
    params: CGParams,
    rounds: int,
    anchored: bool = False,
    saved: Rounds | None = None,
) -> tuple[Written, list[dict]]:
    """Up to `rounds` rounds on `tiles` from the weights `w` of the state `start`.

    The penalty is on the weights, or with `anchored` on their distance to `start`. Returns the state
    reached, which the caller drops, and one trace row per round. With `saved`, each round is saved,
    and rounds saved before are not made again; not to be used with `anchored`.
    """
    n = tiles.n
    scale = float(params.scale or n or 1)
    none = F.lit(None).cast("binary")
    centre = F.col("w") if anchored else none
    state = start.withColumns({"centre": centre, "mu": none, "g": none})
    beta, alpha, trace = 0.0, 0.0, []
    if saved is not None and (last := saved.last()) is not None:
        vectors, trace = saved.load(last)
        state, beta = _reloaded(tiles, vectors), 1.0
        if trace[-1]["w_diff_norm"] < params.eps:
            return Written(stepped(state, beta, alpha)), trace
    held = [Written(tiles.at_blocks(tiles.at_tiles(_weights(state)), None, _at_start, _MARGINS))]
    margins, behind = held[0].rows, 0.0
    try:
        for i in range(len(trace), rounds):
            began = time.monotonic()
            # Margins and weights are as far back as the step that is made when they are read.
            data_g = tiles.transposed(tiles.to_tiles(margins, _residual(behind)))
            turned = Written(_turn(state, data_g, beta, alpha, params.lam, scale))
            held.append(turned)
            s = turned.rows.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in _SUMS)).first()
            tol = restart_bound(params, s.g_old2, s.old_mu2)
            turn = dai_yuan(i == 0, s.gtold, s.gg, s.mu_g - s.gtold, s.g_old2, tol)
            b = turn or 0.0
            # Products with the new direction, b * mu - g.
            mu2 = max(0.0, b * b * s.old_mu2 - 2 * b * s.mu_g + s.gg)
            gtd, w_mu = b * s.mu_g - s.gg, b * s.w_mu - s.w_g
            sent = tiles.at_tiles(_direction(turned.rows, b))
            passed = Written(tiles.at_blocks(sent, margins.select("r", "z", "xm"), _along(behind), _MARGINS))
            held.append(passed)
            data = passed.rows.agg(
                F.coalesce(F.sum("curvature"), F.lit(0.0)).alias("curvature"),
                F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"),
            ).first()
            uhu = (data.curvature + params.lam * mu2) / scale
            # What this round wrote holds all that the next one needs.
            state, margins, beta, alpha = turned.rows, passed.rows, b, quadratic_step(gtd, uhu)
            behind = alpha
            for table in held[:-2]:
                table.drop()
            held = held[-2:]
            moved = abs(alpha) * mu2**0.5
            trace.append(
                {
                    "iter": i,
                    "loglik": (params.lam / 2 * s.off2 + data.loss) / max(n, 1),
                    "rtime": time.monotonic() - began,
                    "alpha": alpha,
                    "beta": b,
                    "w_norm": max(0.0, s.ww + 2 * alpha * w_mu + alpha**2 * mu2) ** 0.5,
                    "w_diff_norm": moved,
                    "w0": s.w0 + alpha * (b * s.mu0 - s.g0),
                    "grad_norm": s.gg**0.5,
                    "gtd": gtd,
                    "uhu": uhu,
                    "gtold": s.gtold,
                }
            )
            if saved is not None:
                saved.save(i, _saved(state, beta, alpha), trace)
            if moved < params.eps:
                break
        return Written(stepped(state, beta, alpha)), trace
    finally:
        for table in held:
            table.drop()


def _saved(state: DataFrame, beta: float, alpha: float) -> DataFrame:
    """What `Rounds` keeps: weights after the step, its direction, and the gradient before it."""

    def one(n, v, cells):
        w, mu = _advanced(v["w"], v["mu"], v["g"], beta, alpha)
        return {"w": w, "mu": mu, "g": v["g"]}

    return _mapped(state, VECTORS_SCHEMA, one)


def _reloaded(tiles: Tiles, vectors: DataFrame) -> DataFrame:
    """The state that `_advanced` with beta 1 and alpha 0 turns into the saved vectors."""
    none = F.lit(None).cast("binary").alias("centre")
    both = tiles.ranges.join(vectors.drop("n"), "key").select(*tiles.ranges.columns, "w", none, "mu", "g")
    return _mapped(both, _STATE, lambda n, v, cells: {"mu": v["mu"] + v["g"]})


def stepped(state: DataFrame, beta: float, alpha: float) -> DataFrame:
    """`state` with the weights after its step, and no direction."""

    def one(n, v, cells):
        return {"w": _advanced(v["w"], v["mu"], v["g"], beta, alpha)[0], "centre": None, "mu": None, "g": None}

    return _mapped(state, _STATE, one)


def mixed(first: DataFrame, second: DataFrame, a: float, b: float) -> DataFrame:
    """The state whose weights are a times those of `first` plus b times those of `second`."""
    other = second.select(F.col("key").alias("_key"), F.col("w").alias("_w"))

    def one(n, v, cells):
        return {"w": a * v["w"] + b * _vector(cells["_w"], n), "centre": None, "mu": None, "g": None}

    return _mapped(first.join(other, F.col("key") == F.col("_key")), _STATE, one, ("_w",))


def weight_rows(state: DataFrame, columns: int) -> DataFrame:
    """`(idx, w)`: one row for each dimension."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, n, w = (c[i] for c in batch.columns)
                idx = np.arange(n.as_py(), dtype=np.int32) + key.as_py() * columns
                yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(_vector(w, n.as_py()))], ["idx", "w"])

    return state.select("key", "n", "w").mapInArrow(unfold, "idx INT, w DOUBLE")


def train_cg_join(examples: DataFrame, params: CGParams, rounds_at: str | None = None) -> Fit:
    """`train_cg(method="join")` on example rows or packed blocks."""
    tiles = in_tiles(examples)
    try:
        saved = saved_rounds(examples.sparkSession, rounds_at, params, tiles.n, tiles.d)
        state, trace = minimise_tables(tiles, zero_state(tiles), params, params.max_iter, saved=saved)
        return Fit(weight_rows(state.rows, tiles.columns), trace_table(examples.sparkSession, trace), tiles.n, tiles.d)
    finally:
        tiles.drop()
