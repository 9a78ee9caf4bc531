"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clicktide.llm.text import NOT_ALNUM, Slice, measured, mix

TERM_BITS = 18
# Beginnings of words that are terms too, in letters.
PREFIXES = (4, 5)
FACTORS = 8
# At most so many labelled rows are fitted on, chosen by the hash of their doc_id.
FIT_ROWS = 10_000
# Terms in fewer fitted rows than this have no weight of their own.
LEAST_ROWS = 8
STEPS = 800
RATE = 0.3
DECAY = 1e-6
# One fitted row in so many is kept from the weights, to scale the margins to chances.
CALIBRATE = 5
BATCH = 128
SEED = 7


@dataclass
class Machine:
    """Bias, and by term (of 2 ** TERM_BITS) a weight, factors, and whether it is used."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    used: np.ndarray


def _hashed(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of each word and of the beginnings of words, which inflected forms share."""
    spans = part.bytes_hashed()
    letters = np.flatnonzero((part.raw & 0xC0) != 0x80)
    at = np.searchsorted(letters, part.starts)
    letters = np.append(letters, len(part.raw))
    docs, hashes = [part.doc], [spans.hashes(part.starts, part.ends)]
    for k in PREFIXES:
        end = letters[np.minimum(at + k, len(letters) - 1)]
        longer = (end <= part.ends) & (at + k < len(letters))
        docs.append(part.doc[longer])
        hashes.append(mix(spans.hashes(part.starts[longer], end[longer]) + np.uint64(k)))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def terms(part: Slice, used: np.ndarray | None = None):
    """(document, term, value) of a slice: each term of a document once.

    The value is the root of the term's share of the document's words, so that texts of any
    length compare. Only `used` terms are listed, but all words count for the shares.
    """
    doc, term = _hashed(part)
    if used is not None:
        keep = used[term]
        term, doc = term[keep], doc[keep]
    key, n = np.unique((doc << TERM_BITS) | term, return_counts=True)
    doc, term = key >> TERM_BITS, key & ((1 << TERM_BITS) - 1)
    words = np.diff(part.word_bounds)
    return doc, term, np.sqrt(n / words[doc])


def _by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of `values` by document; `doc` ascends."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=sums[1:])
    at = np.searchsorted(doc, np.arange(n + 1))
    return sums[at[1:]] - sums[at[:-1]]


def margins(model: Machine, doc: np.ndarray, term: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    linear = _by_doc(model.weights[term] * x, doc, n)
    vx = model.factors[term] * x[:, None]
    pairs = _by_doc(vx, doc, n) ** 2 - _by_doc(vx**2, doc, n)
    return model.bias + linear + pairs.sum(axis=1) / 2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrated(model: Machine, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """`model` with its margins stretched and shifted to fit the labels of rows it has not seen."""
    if not 0 < labels.sum() < len(labels):
        return model
    rows = [(t[model.used[t]], x[model.used[t]]) for t, x in rows]
    doc = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    z = margins(model, doc, *(np.concatenate(c) for c in zip(*rows)), len(rows))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, with a weak pull of the stretch towards one
        p = _sigmoid(a * z + b)
        slope = np.array([((p - labels) * z).sum() + 0.1 * (a - 1), (p - labels).sum()])
        w = p * (1 - p) + 1e-6
        bend = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
        move = np.clip(np.linalg.solve(bend, slope), -1, 1)
        a, b = max(a - move[0], 0.1), b - move[1]
    return Machine(a * model.bias + b, a * model.weights, np.sqrt(a) * model.factors, model.used)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """A calibrated machine for (terms, values) of each row; the same rows give the same model."""
    held = np.arange(len(rows)) % CALIBRATE == CALIBRATE - 1
    parts = [[r for r, h in zip(rows, held) if h == kind] for kind in (False, True)]
    model = calibrated(_fit(parts[0], labels[~held]), parts[1], labels[held])
    model.weights, model.factors = model.weights.astype(np.float32), model.factors.astype(np.float32)
    return model


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Logistic loss by AdaGrad."""
    size = 1 << TERM_BITS
    n_rows = len(rows)
    rate = (labels.sum() + 0.5) / (n_rows + 1)
    model = Machine(
        float(np.log(rate / (1 - rate))), np.zeros(size), np.zeros((size, FACTORS)), np.zeros(size, bool)
    )
    if n_rows == 0:
        return model
    seen = np.bincount(np.concatenate([t for t, _ in rows]), minlength=size)
    model.used = seen >= LEAST_ROWS
    rng = np.random.default_rng(SEED)
    model.factors[model.used] = rng.normal(0, 0.05, (int(model.used.sum()), FACTORS))
    rows = [(t[model.used[t]], x[model.used[t]]) for t, x in rows]
    g_w, g_v, g_b = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    order = np.zeros(0, np.int64)
    for _ in range(STEPS):
        if len(order) < min(BATCH, n_rows):
            order = rng.permutation(n_rows)
        chosen, order = order[:BATCH], order[BATCH:]
        n = len(chosen)
        term = np.concatenate([rows[i][0] for i in chosen])
        x = np.concatenate([rows[i][1] for i in chosen])
        doc = np.repeat(np.arange(n), [len(rows[i][0]) for i in chosen])
        vx = model.factors[term] * x[:, None]
        sums = _by_doc(vx, doc, n)
        z = model.bias + _by_doc(model.weights[term] * x, doc, n)
        z += (sums**2 - _by_doc(vx**2, doc, n)).sum(axis=1) / 2
        error = (_sigmoid(z) - labels[chosen]) / n
        at = np.argsort(term, kind="stable")
        each, first = np.unique(term[at], return_index=True)
        step = (error[doc] * x)[:, None]
        d_w = np.add.reduceat(step[at, 0], first) + DECAY * model.weights[each]
        d_v = np.add.reduceat((step * (sums[doc] - vx))[at], first, axis=0) + DECAY * model.factors[each]
        g_w[each] += d_w**2
        g_v[each] += d_v**2
        g_b += error.sum() ** 2
        model.weights[each] -= RATE * 10 * d_w / np.sqrt(g_w[each])
        model.factors[each] -= RATE * d_v / np.sqrt(g_v[each])
        model.bias -= RATE * error.sum() / np.sqrt(g_b)
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on at most `fit_rows` rows of `labels` (doc_id, toxic) with their texts.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. If there are more than `fit_rows`,
    those with the least hash of their doc_id are taken, and only their texts reach the driver,
    as lists of terms. Of several labels of a document the largest counts, of several texts that of the
    least hash; null labels and doc_ids do not count. Texts may be null, empty or very long. Without
    labels, or without texts, every margin is the same. Other columns are ignored.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.filter(F.col("toxic").isNotNull() & (rest != 0))
    chosen = (
        known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One text a document: no more than `fit_rows` rows go on, however often a document repeats.
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    texts = texts.groupBy("doc_id", "toxic").agg(one)

    def listed(part: Slice) -> list:
        doc, term, x = terms(part)
        bounds = np.searchsorted(doc, np.arange(part.n + 1)).astype(np.int32)
        lists = [pa.array(term.astype(np.int32)), pa.array(x.astype(np.float32))]
        return [pa.ListArray.from_arrays(pa.array(bounds), values) for values in lists]

    fields = [("terms", "array<int>"), ("shares", "array<float>")]
    found = measured(texts, fields, listed, separator=NOT_ALNUM, lower=True, drop=("text",)).toArrow()
    # Rows are put in a fixed order, so that reruns agree.
    doc_ids = found.column("doc_id").to_pylist()
    columns = [found.column(c).combine_chunks() for c in ("terms", "shares")]
    bounds = [np.asarray(c.offsets) for c in columns]
    flat = [c.values.to_numpy() for c in columns]
    cut = lambda k, i: flat[k][bounds[k][i] : bounds[k][i + 1]]
    order = sorted(range(len(doc_ids)), key=doc_ids.__getitem__)
    rows = [(cut(0, i).astype(np.int64), cut(1, i).astype(np.float64)) for i in order]
    toxic = found.column("toxic").to_numpy()[order] if order else np.zeros(0)
    return fit(rows, (toxic > 0).astype(float))


def score(docs: DataFrame, model: Machine, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with `score`, the estimated chance that the text is toxic.

    Whole texts, one narrow pass; the model has a fixed size and is broadcast. Null and empty
    texts get the model's bias, very long ones a score like any other. Repeated rows get equal scores,
    an empty table stays empty. A column `score` is replaced, others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(part: Slice) -> list:
        known = shared.value
        return [_sigmoid(margins(known, *terms(part, known.used), part.n))]

    return measured(docs, [("score", "double")], rate, separator=NOT_ALNUM, lower=True, drop=drop)


def op7_toxicity(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model, drop=("text",)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
