import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from clicktide.llm import toxicity
from clicktide.llm.text import NOT_ALNUM, slices


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(900):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if toxic:
            words[:: 9] = [rng.choice(["scumful", "scumly", "vile"]) for _ in words[::9]]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark, make_docs, corpus):
    docs = make_docs([(i, t) for i, t, _ in corpus])
    return toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, toxic int"))


def test_held_out_accuracy(make_docs, corpus, model):
    rows = toxicity.score(make_docs([(i, t) for i, t, _ in corpus]), model).collect()
    got = {r.doc_id: r.score for r in rows}
    held = [(got[i] >= 0.5) == (y == 1) for i, _, y in corpus if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_the_same_rows_give_the_same_model(spark, make_docs, corpus, model):
    docs = make_docs([(i, t) for i, t, _ in corpus]).repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in reversed(corpus)], "doc_id long, toxic int")
    again = toxicity.train(docs, labels)
    assert again.bias == model.bias and (again.weights == model.weights).all()


def test_held_out_labels_are_not_learned(spark, make_docs, corpus, model):
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in corpus]
    labels = spark.createDataFrame(flip + [(10_000, None)], "doc_id long, toxic int")
    again = toxicity.train(make_docs([(i, t) for i, t, _ in corpus]), labels)
    assert (again.weights == model.weights).all()


def test_pairs_weigh_more_than_their_terms():
    """Only the pair is toxic: a sum of weights cannot tell, the factors can."""
    rng = np.random.default_rng(0)
    a, b, rows, labels = 3, 4, [], []
    for i in range(1200):
        have = [i % 2 == 0, i % 4 < 2]
        terms = [t for t, h in zip((a, b), have) if h] + [10 + int(rng.integers(20))]
        rows.append((np.array(terms), np.full(len(terms), len(terms) ** -0.5)))
        labels.append(float(have[0] == have[1]))
    machine = toxicity._fit(rows, np.array(labels))
    z = [toxicity.margins(machine, np.zeros(len(t), int), t, x, 1)[0] for t, x in rows]
    assert np.mean((np.array(z) > 0) == (np.array(labels) > 0)) > 0.9


def test_factors_equal_the_sum_over_pairs(model):
    (part,) = slices(pa.array(["vile scumly word1 word2 vile", "", "word3"]), NOT_ALNUM, True)
    doc, term, x = toxicity.terms(part, model.used)
    got = toxicity.margins(model, doc, term, x, part.n)
    for d in range(part.n):
        t, v = term[doc == d], x[doc == d]
        z = model.bias + (model.weights[t] * v).sum()
        z += sum(
            model.factors[t[i]] @ model.factors[t[j]] * v[i] * v[j] for i in range(len(t)) for j in range(i)
        )
        assert got[d] == pytest.approx(z, rel=1e-5, abs=1e-6)


def test_odd_rows(spark, make_docs, odd_texts, model):
    docs = make_docs(odd_texts)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_no_labels_give_one_score(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5 * 2 * toxicity._sigmoid(np.array(0.0))}


def test_query(spark, small, given):
    rows = toxicity.op7_toxicity(spark, small).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in given}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_fitted_rows_are_bounded(spark, make_docs, corpus, monkeypatch):
    """One document that repeats does not send its copies to the driver; ids may be text."""
    sent = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels: sent.append(len(rows)) or fit(rows, labels))
    docs = make_docs([(i, t) for i, t, _ in corpus] + [(2, f"copy {k % 3}") for k in range(3000)])
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus] * 2, "doc_id long, toxic int")
    a = toxicity.train(docs, labels, 40)
    text = lambda df: df.withColumn("doc_id", df.doc_id.cast("string"))
    toxicity.train(text(docs), text(labels), 40)
    assert sent == [40, 40]
    b = toxicity.train(docs.repartition(7), labels, 40)
    assert (a.weights == b.weights).all() and (a.factors == b.factors).all()
