"""Quality by logistic regression over hashed n-grams of words and of word classes, trained by
follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clicktide.llm.storage import stored
from clicktide.llm.text import NOT_ALNUM, WHITE, WORD_BASE, Slice, Spans, measured, mix

TERM_BITS = 18
# n-grams of 1 to ORDER words, and of 1 to CLASS_ORDER classes of words.
ORDER, CLASS_ORDER = 2, 3
# A word's class tells how many words before it stands the same one, up to so many.
BACK = 8
# At most so many labelled documents are fitted on, chosen by the hash of their doc_id.
FIT_ROWS = 20_000
# Each pass is made by so many learners, whose states are averaged after it.
LEARNERS = 8
PASSES = 4
# Step size and its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 0.1, 1e-3, 1e-4

# White space, words (letters, digits, all beyond ASCII), and everything else: marks.
_KIND = np.where(WHITE, 0, np.where(NOT_ALNUM, 2, 1)).astype(np.int8)


@dataclass
class State:
    """Sums of gradients corrected by the steps made (`z`) and of squared gradients (`n`), by term;
    the last entry is the bias, which is not penalised."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def fresh(cls) -> State:
        return cls(np.zeros((1 << TERM_BITS) + 1), np.zeros((1 << TERM_BITS) + 1))

    def weights(self, at: np.ndarray) -> np.ndarray:
        """The leader's weights at some places: zero up to the first penalty, else shrunken."""
        z, rate = self.z[at], (BETA + np.sqrt(self.n[at])) / ALPHA
        bias = at == 1 << TERM_BITS
        small = np.where(bias, 0.0, L1)
        return np.where(np.abs(z) <= small, 0.0, (np.sign(z) * small - z) / (rate + np.where(bias, 0.0, L2)))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (_sigmoid(w @ x) - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, class) of each word or run of marks, as written.

    Words that a corpus has never seen are still known by their class: the distance to the same word
    before it if that is near, else kind and case.
    """
    kind = _KIND[part.raw]
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[part.bounds[:-1][part.bounds[:-1] < len(kind)]] = True
    cuts = np.flatnonzero(first)
    ends = np.append(cuts[1:], len(kind)) if len(cuts) else cuts
    real = kind[cuts] > 0
    starts, ends = cuts[real], ends[real]
    doc = np.searchsorted(part.bounds, starts, "right") - 1
    hashes = part.bytes_hashed().hashes(starts, ends)
    upper = (part.raw >= ord("A")) & (part.raw <= ord("Z"))
    shape = kind[starts] + 3 * upper[starts] + 6 * (upper[ends - 1] & (ends - starts > 1))
    shape = BACK + shape.astype(np.int64)
    for k in range(BACK, 0, -1):
        same = (hashes[k:] == hashes[:-k]) & (doc[k:] == doc[:-k])
        shape[k:][same] = k
    return doc, hashes, shape


def features(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, value): each hashed n-gram of a document once, by document and term.

    The value is the root of the n-gram's share among those of the document, so that every text
    has length one.
    """
    doc, hashes, shape = words(part)
    docs, terms = [], []
    for values, most in ((hashes, ORDER), (mix(shape.astype(np.uint64)), CLASS_ORDER)):
        spans = Spans(values, WORD_BASE)
        for k in range(1, most + 1):
            at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :]) if len(doc) >= k else doc[:0]
            docs.append(doc[at])
            terms.append((spans.hashes(at, at + k) >> np.uint64(64 - TERM_BITS)).astype(np.int64))
    doc = np.concatenate(docs)
    key, count = np.unique((doc << TERM_BITS) | np.concatenate(terms), return_counts=True)
    total = np.bincount(doc, minlength=part.n)
    doc, term = key >> TERM_BITS, key & ((1 << TERM_BITS) - 1)
    return doc, term, np.sqrt(count / total[doc])


def _listed(part: Slice) -> list:
    doc, term, x = features(part)
    bounds = pa.array(np.searchsorted(doc, np.arange(part.n + 1)).astype(np.int32))
    lists = [pa.array(term.astype(np.int32)), pa.array(x.astype(np.float32))]
    return [pa.ListArray.from_arrays(bounds, values) for values in lists]


def chosen_labels(labels: DataFrame, fit_rows: int) -> DataFrame:
    """`(_doc, _label)`: at most `fit_rows` labelled documents that are not held out."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    known = labels.filter(F.col("quality").isNotNull() & (rest != 1))
    best = known.groupBy("doc_id").agg(F.max("quality").alias("_label"))
    first = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return first.select(F.col("doc_id").alias("_doc"), "_label")


def fitting_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`(learner, place, label, terms, shares)`: one row for each chosen document that has a text.

    Of several texts of a doc_id, that of the least hash is taken, so that no more than `fit_rows`
    rows are fitted on however often a document repeats.
    """
    texts = docs.select("doc_id", "text").join(
        F.broadcast(chosen_labels(labels, fit_rows)), F.col("doc_id") == F.col("_doc")
    )
    one = texts.groupBy("doc_id", "_label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    place = F.xxhash64("doc_id", F.lit(1))
    rows = one.select(
        F.pmod(place, F.lit(LEARNERS)).cast("int").alias("learner"),
        place.alias("place"),
        (F.col("_label") > 0).cast("double").alias("label"),
        "text",
    )
    return measured(rows, [("terms", "array<int>"), ("shares", "array<float>")], _listed, drop=("text",))


def _one_pass(rows: DataFrame, state: State) -> State:
    """The mean of what LEARNERS learners make of `state`, each from its own rows in a fixed order."""
    shared = rows.sparkSession.sparkContext.broadcast(state)
    bias = 1 << TERM_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, own = None, None

        def told():
            arrays = [pa.array([learner], pa.int32()), pa.array([own.z.tobytes()]), pa.array([own.n.tobytes()])]
            return pa.RecordBatch.from_arrays(arrays, ["learner", "z", "n"])

        for batch in batches:
            whose, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                if whose[i] != learner:
                    if own is not None:
                        yield told()
                    learner, own = int(whose[i]), State(shared.value.z.copy(), shared.value.n.copy())
                at = np.append(batch.column(2)[i].values.to_numpy(), bias)
                own.learn(at, np.append(batch.column(3)[i].values.to_numpy().astype(np.float64), 1.0), labels[i])
        if own is not None:
            yield told()

    # A task may hold several learners' rows, one learner after another.
    dealt = rows.repartition(LEARNERS, "learner").sortWithinPartitions("learner", "place", "label", "terms")
    told = dealt.select("learner", "label", "terms", "shares").mapInArrow(run, "learner INT, z BINARY, n BINARY")
    states = sorted(told.toArrow().to_pylist(), key=lambda r: r["learner"])
    if not states:
        return state
    read = lambda name: np.mean([np.frombuffer(s[name], np.float64) for s in states], axis=0)
    return State(read("z"), read("n"))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, passes: int = PASSES) -> np.ndarray:
    """Weights by term, the bias last, from at most `fit_rows` rows of `labels` (doc_id, quality).

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out. Only texts and labels are learned from.
    Learning runs in LEARNERS tasks; only their states, of fixed size, reach the driver. The same rows
    give the same weights, however they are stored. Of several labels of a document the largest
    counts; null labels and doc_ids do not. Texts may be null, empty or very long. Without labels
    all weights are zero.
    """
    rows = stored(fitting_rows(docs, labels, fit_rows))
    state = State.fresh()
    for _ in range(passes):
        state = _one_pass(rows, state)
    return state.weights(np.arange(len(state.z))).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with `score`, the estimated chance that the text is of good quality.

    Whole texts in one narrow pass: the sparse product of a text's n-grams with the weights, which
    have a fixed size and are broadcast. Null and empty texts get the bias alone, repeated rows equal
    scores, an empty table stays empty. A column `score` is replaced, others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def rate(part: Slice) -> list:
        known = shared.value
        doc, term, x = features(part)
        z = np.bincount(doc, weights=known[term] * x, minlength=part.n)
        return [_sigmoid(z + float(known[-1]))]

    return measured(docs, [("score", "double")], rate, drop=drop)


def op13_quality(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    weights = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(docs, weights, drop=("text",)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
