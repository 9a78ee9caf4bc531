import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from clicktide.llm import classifier as cl
from clicktide.llm.text import slices


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def corpus():
    """Junk repeats a word that is nowhere else, or is full of marks."""
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if i % 8 == 0:
            words = words[:5] + [f"new{i}"] * 30
        if i % 8 == 4:
            words = [w + " |" for w in words]
        rows.append((i, " ".join(words), int(i % 4 != 0)))
    return rows


@pytest.fixture(scope="module")
def labels(spark, corpus):
    return spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, quality int")


@pytest.fixture(scope="module")
def weights(make_docs, corpus, labels):
    return cl.train(make_docs([(i, t) for i, t, _ in corpus]), labels)


def test_held_out_accuracy(make_docs, corpus, weights):
    got = {r.doc_id: r.score for r in cl.score(make_docs([(i, t) for i, t, _ in corpus]), weights).collect()}
    right = [(got[i] >= 0.5) == (y == 1) for i, _, y in corpus if held(i)]
    assert len(right) > 200 and np.mean(right) > 0.97


def test_the_same_rows_give_the_same_weights(spark, make_docs, corpus, weights):
    docs = make_docs([(i, t) for i, t, _ in corpus]).repartition(5)
    again = cl.train(docs, spark.createDataFrame([(i, y) for i, _, y in reversed(corpus)], "doc_id long, quality int"))
    assert (again == weights).all() and (weights != 0).sum() > 50


def test_held_out_labels_are_not_learned(spark, make_docs, corpus, weights):
    flip = [(i, 1 - y if held(i) else y) for i, _, y in corpus] + [(10_000, None), (None, 1)]
    labels = spark.createDataFrame(flip, "doc_id long, quality int")
    assert (cl.train(make_docs([(i, t) for i, t, _ in corpus]), labels) == weights).all()


def test_fitted_rows_are_bounded(spark, make_docs, corpus, labels):
    docs = make_docs([(i, t) for i, t, _ in corpus] + [(2, f"copy {k}") for k in range(500)] + [(3, None)] * 50)
    rows = cl.fitting_rows(docs, labels.unionByName(labels), 40)
    assert rows.count() == 40
    assert rows.columns == ["learner", "place", "label", "terms", "shares"]
    assert cl.fitting_rows(docs, labels, 10**6).count() == sum(not held(i) for i, _, _ in corpus)


def test_score_is_a_sparse_product(make_docs, weights):
    texts = ["word1 word1, WORD2 |", "", "x"]
    (part,) = slices(pa.array(texts))
    doc, term, x = cl.features(part)
    got = {r.doc_id: r.score for r in cl.score(make_docs(list(enumerate(texts))), weights).collect()}
    for d in range(3):
        assert (x[doc == d] ** 2).sum() == pytest.approx(float(d != 1))
        z = weights[term[doc == d]].astype(float) @ x[doc == d] + float(weights[-1])
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)


def test_words_and_classes():
    (part,) = slices(pa.array(["The cat, the the!", "", "The x9 É"]))
    doc, hashes, shape = cl.words(part)
    assert doc.tolist() == [0] * 6 + [2] * 3
    assert hashes[0] == hashes[6] and hashes[3] == hashes[4] and hashes[0] != hashes[3]
    assert shape[4] == 1 and shape[6] == shape[0] > cl.BACK  # repeats do not reach across texts
    assert shape[2] == shape[5] and shape[0] != shape[1]


def test_leader_is_the_minimum_of_its_regularised_sum():
    """The closed form against a search over weights."""
    rng = np.random.default_rng(2)
    state, at, kept = cl.State.fresh(), np.array([3, 1 << cl.TERM_BITS]), []
    for _ in range(40):
        x = rng.normal(0, 1, 2)
        w = state.weights(at)
        label = float(rng.random() < 0.6)
        n0 = state.n[at].copy()
        state.learn(at, x, label)
        g = (1 / (1 + np.exp(-(w @ x))) - label) * x
        kept.append((g, (np.sqrt(state.n[at]) - np.sqrt(n0)) / cl.ALPHA, w))
    grid = np.linspace(-3, 3, 60_001)
    for k, l1 in ((0, cl.L1), (1, 0.0)):
        total = cl.BETA / cl.ALPHA * grid**2 / 2 + l1 * np.abs(grid) + (cl.L2 if l1 else 0) * grid**2 / 2
        for g, s, w in kept:
            total += g[k] * grid + s[k] / 2 * (grid - w[k]) ** 2
        assert grid[total.argmin()] == pytest.approx(state.weights(at)[k], abs=2e-4)


def test_odd_rows(spark, make_docs, odd_texts, weights):
    docs = make_docs(odd_texts)
    rows = cl.score(docs, weights).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert cl.score(docs.limit(0), weights).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert not cl.train(docs, none).any() and not cl.train(docs.limit(0), none).any()
    some = spark.createDataFrame([(r[0], 1) for r in odd_texts], "doc_id long, quality int")
    assert np.isfinite(cl.train(docs, some)).all()


def test_query(spark, small, given):
    rows = cl.op13_quality(spark, small).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in given}
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in rows)
