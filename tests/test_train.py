"""Passes against numpy, both forms against each other, training against MLlib."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks.fixtures import document_examples, impressions
from clicktide.operators import evaluate as ev
from clicktide.operators import objective as ob
from clicktide.operators.batches import assign_batches, batch_count
from clicktide.operators.blocks import few_tasks, pack
from clicktide.operators.encode import encode
from clicktide.operators.reduce import RANGE, RANGES, collect_ranges, in_ranges, range_entries, sum_ranges
from clicktide.operators.samples import count_samples, expanded_samples
from clicktide.plans import jobs
from clicktide.plans.cg import train_cg
from clicktide.plans.minibatch import train_cg_minibatch
from clicktide.plans.params import CGParams
from clicktide.session import cached

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return document_examples(spark, SF).persist()


@pytest.fixture(scope="module")
def clicks(spark, small):
    imps = impressions(spark, small)
    return encode(imps, jobs.build_dictionary(imps, 60)).persist()


def dense(examples):
    rows = examples.collect()
    d = max(max(r.idx) for r in rows) + 1
    x = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        np.add.at(x[i], r.idx, 1.0)
    return x, np.array([r.pos for r in rows], float), np.array([r.neg for r in rows], float)


def loss_of(x, pos, neg, w):
    z = x @ w
    return pos @ np.logaddexp(0, -z) + neg @ np.logaddexp(0, z)


def grad_of(x, pos, neg, w):
    s = 1 / (1 + np.exp(-(x @ w)))
    return x.T @ ((pos + neg) * s - pos)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("packed", [False, True])
def test_passes_match_numpy(clicks, parts, packed):
    x, pos, neg = dense(clicks)
    rng = np.random.default_rng(3)
    w, mu = rng.normal(0, 0.3, x.shape[1]), rng.normal(0, 1, x.shape[1])
    data = clicks.repartition(parts)
    passes = ob.PackedObjective(pack(data) if packed else data, len(w), parts)
    assert passes.direct
    shuffled, _ = ob.PackedObjective(data, len(w)).gradient(w)
    assert np.allclose(passes.gradient(w)[0], shuffled, atol=1e-10)
    g, loss = passes.gradient(w)
    assert np.allclose(g, grad_of(x, pos, neg, w), rtol=1e-10, atol=1e-9)
    assert loss == pytest.approx(loss_of(x, pos, neg, w), rel=1e-12)
    assert passes.loss(w) == pytest.approx(loss, rel=1e-12)
    s = 1 / (1 + np.exp(-(x @ w)))
    assert passes.curvature(w, mu) == pytest.approx(((pos + neg) * s * (1 - s)) @ (x @ mu) ** 2)
    # finite differences of loss and gradient
    h = 1e-6
    assert (passes.loss(w + h * mu) - passes.loss(w - h * mu)) / (2 * h) == pytest.approx(g @ mu, rel=1e-5)
    slope = (passes.gradient(w + h * mu)[0] - passes.gradient(w - h * mu)[0]) @ mu / (2 * h)
    assert slope == pytest.approx(passes.curvature(w, mu), rel=1e-5)


@pytest.mark.parametrize("head", [0, 5, 10**6])
def test_join_form_matches_packed(spark, clicks, head):
    x, _, _ = dense(clicks)
    w = np.random.default_rng(4).normal(0, 0.3, x.shape[1])
    table = ob.weights_table(spark, w)
    rows = ob.with_rows(clicks)
    joined = ob.margins_join(rows, table, head_dims=head)
    a = {(r.req, r.seg): r.z for r in joined.collect()}
    b = {(r.req, r.seg): r.z for r in ob.with_margin(clicks, w).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    g = ob.collect_vector(ob.gradient_join(rows, joined).withColumnRenamed("g", "v"), len(w))
    assert np.allclose(g, ob.PackedObjective(clicks, len(w)).gradient(w)[0], atol=1e-9)


def test_dimensions_beyond_the_model_are_skipped(spark, clicks):
    w = np.array([0.5, 1.0, 2.0])
    expected = [sum(w[i] for i in r.idx if i < 3) for r in clicks.orderBy("req", "seg").collect()]
    for rows in (
        ob.with_margin(clicks, w),
        ob.margins_join(clicks, ob.weights_table(spark, w)),
    ):
        assert [r.z for r in rows.orderBy("req", "seg").collect()] == pytest.approx(expected)


def test_weights_round_trip(spark):
    w = np.array([0.0, -1.5, 3.0])
    assert ob.weights_vector(ob.weights_table(spark, w)).tolist() == w.tolist()
    with pytest.raises(ValueError):
        ob.weights_vector(ob.weights_table(spark, w), max_dim=2)


def test_counted_and_expanded_samples_agree(clicks):
    flat = count_samples(expanded_samples(clicks).select("req", "seg", "k", "y", "idx"))
    w = np.random.default_rng(5).normal(0, 0.2, dense(clicks)[0].shape[1])
    a, b = ob.with_margin(clicks, w), ob.with_margin(flat, w)
    assert ev.accuracy(a).first() == ev.accuracy(b).first()
    assert ev.auc_roc(a).first().auc == pytest.approx(ev.auc_roc(b).first().auc, abs=1e-12)
    ga, la = ob.PackedObjective(clicks, len(w)).gradient(w)
    gb, lb = ob.PackedObjective(flat, len(w)).gradient(w)
    assert np.allclose(ga, gb, atol=1e-9) and la == pytest.approx(lb)


def test_auc_against_mllib_and_pairs(spark, docs):
    w = np.random.default_rng(6).normal(0, 1, 34)
    rows = ob.with_margin(docs, w)
    auc = ev.auc_roc(rows).first().auc
    scored = ev.predict(rows).select(
        F.array(1 - F.col("p"), F.col("p")).alias("v"), F.col("pos").cast("double").alias("label")
    )
    vectors = scored.select("label", array_to_vector("v").alias("rawPrediction"))
    assert auc == pytest.approx(BinaryClassificationEvaluator(numBins=0).evaluate(vectors), abs=1e-12)
    r = rows.collect()
    p = np.array([x.z for x in r if x.pos])[:, None]
    q = np.array([x.z for x in r if x.neg])[None, :]
    assert auc == pytest.approx(((p > q) + 0.5 * (np.abs(p - q) < 1e-12)).mean(), abs=1e-9)


def test_auc_edge_cases(spark):
    tied = spark.createDataFrame([(3, 2, 0.5), (1, 4, 0.5)], "pos LONG, neg LONG, z DOUBLE")
    assert ev.auc_roc(tied).first().auc == 0.5
    assert ev.auc_roc(tied.withColumn("neg", F.lit(0))).first().auc is None
    assert ev.auc_roc(tied.filter("false")).first().auc is None
    assert ev.accuracy(tied.filter("false")).first().accuracy is None
    spread = spark.range(2000).select(
        (F.col("id") % 3).alias("pos"), (F.col("id") % 2).alias("neg"), (F.col("id") / 1000 - 1).alias("z")
    )
    rows = spread.collect()
    pos, neg = np.array([r.pos for r in rows]), np.array([r.neg for r in rows])
    expected = (pos @ (np.cumsum(neg) - neg / 2)) / (pos.sum() * neg.sum())
    assert ev.auc_roc(spread.repartition(6)).first().auc == pytest.approx(expected, abs=1e-12)


def test_tie_counts_as_positive(spark):
    rows = spark.createDataFrame([(1, 0, 0.0), (0, 1, -0.1)], "pos LONG, neg LONG, z DOUBLE")
    assert [r.label for r in ev.predict(rows).orderBy("z").collect()] == [-1.0, 1.0]
    assert ev.accuracy(rows).first().accuracy == 1.0


@pytest.fixture(scope="module")
def optimum(docs):
    return train_cg(docs, CGParams(max_iter=300), keys=["id"])


def test_converges_to_the_optimum(docs, optimum):
    fit = optimum
    x, pos, neg = dense(docs)
    w = ob.weights_vector(fit.weights)
    objective = loss_of(x, pos, neg, w) + 0.05 * w @ w
    assert objective == pytest.approx(142.580126, abs=1e-6)
    assert np.linalg.norm(grad_of(x, pos, neg, w) + 0.1 * w) < 1e-3
    trace = fit.trace.orderBy("iter").collect()
    assert trace[-1].w_diff_norm < 1e-6 and len(trace) < 300
    assert trace[-1].loglik <= trace[0].loglik
    assert fit.n == 399 and fit.d == 34
    auc = jobs.evaluate(docs, fit.weights, ["id"]).first().auc
    assert auc == pytest.approx(0.772196, abs=1e-4)


def test_same_optimum_as_mllib(spark, docs, optimum):
    # MLlib pins constant columns to zero. The loss does not change under (x, y) -> (-x, -y), so
    # flipping every other row lets the bias column vary.
    x, pos, neg = dense(docs)
    sign = np.where(np.arange(len(x)) % 2 == 0, 1.0, -1.0)
    label = np.where(sign > 0, pos, 1 - pos)
    data = spark.createDataFrame(
        [(float(y), [float(v) for v in r]) for y, r in zip(label, x * sign[:, None])],
        "label DOUBLE, v ARRAY<DOUBLE>",
    ).select("label", array_to_vector("v").alias("features"))
    lr = LogisticRegression(
        regParam=0.1 / len(x), fitIntercept=False, standardization=False, tol=1e-12, maxIter=500
    )
    theirs = lr.fit(data).coefficients.toArray()
    ours = ob.weights_vector(optimum.weights)
    assert np.abs(ours - theirs).max() < 1e-4


def test_join_training_follows_packed(docs):
    params = CGParams(max_iter=4)
    a = train_cg(docs, params, "packed", ["id"])
    b = train_cg(docs, params, "join", ["id"])
    assert np.allclose(ob.weights_vector(a.weights), ob.weights_vector(b.weights), atol=1e-9)
    ta, tb = (f.trace.drop("rtime").orderBy("iter").collect() for f in (a, b))
    assert np.allclose(np.array(ta, float), np.array(tb, float), rtol=1e-7, atol=1e-9)


def odd_examples(spark):
    """NULL and repeated keys, an example without dimensions, a repeated dimension."""
    rows = [
        (None, 1, 3, 1, [0, 1, 2]), (1, 1, 0, 2, []), (2, 1, 1, 0, [0, 2, 2]), (2, 1, 0, 4, [0, 1]), (3, None, 2, 2, [0, 3]),
    ]
    return spark.createDataFrame(rows, "req LONG, seg INT, pos LONG, neg LONG, idx ARRAY<INT>")


def test_forms_agree_on_odd_examples(spark):
    rows, params = odd_examples(spark), CGParams(max_iter=3)
    fits = [train_cg(rows, params, m) for m in ("packed", "join")]
    a, b = (ob.weights_vector(f.weights) for f in fits)
    assert np.allclose(a, b, atol=1e-10)
    ta, tb = (f.trace.drop("rtime").orderBy("iter").collect() for f in fits)
    assert np.allclose(np.array(ta, float), np.array(tb, float), rtol=1e-7, atol=1e-9)
    limits = [train_cg(rows, params, packed_max_dim=d).weights for d in (3, 4)]
    assert np.allclose(*(ob.weights_vector(w) for w in limits), atol=1e-10)
    z = sorted(r.z for r in ob.margins_join(rows, fits[0].weights).collect())
    assert np.allclose(z, sorted(r.z for r in ob.with_margin(rows, a).collect()), atol=1e-12)


def test_minibatch_limit_does_not_change_the_result(spark):
    rows = odd_examples(spark)
    batch = F.coalesce(F.col("req"), F.lit(0)) % 2
    fits = [
        train_cg_minibatch(rows, CGParams(max_iter=1, inner_iter=2), batch=batch, n_batches=2, packed_max_dim=d)
        for d in (3, 4)
    ]
    assert np.allclose(*(ob.weights_vector(f.weights) for f in fits), atol=1e-10)
    with pytest.raises(ValueError):
        train_cg_minibatch(rows, method="packed", packed_max_dim=3)


def test_table_training_leaves_little_on_storage(spark, docs):
    import os

    from clicktide.session import ensure_checkpoint_dir

    place = ensure_checkpoint_dir(spark).removeprefix("file:")
    tables = lambda: {x for x in os.listdir(place) if x.startswith("table-")}
    before = tables()
    fit = train_cg(docs, CGParams(max_iter=4), "join", ["id"])
    assert len(tables() - before) == 1 and fit.weights.count() == fit.d


def test_jobs_check_their_method(spark, small):
    imps = impressions(spark, small)
    with pytest.raises(ValueError):
        jobs.fit(imps, jobs.build_dictionary(imps, 100), method="foo")


def test_export_takes_the_last_of_two_ids(spark):
    weights = ob.weights_table(spark, np.array([0.5, 1.0]))
    dictionary = spark.createDataFrame([(11, 1), (22, 1)], "fid LONG, dim INT")
    rows = jobs.named_weights(weights, dictionary).collect()
    assert sorted((r.fid or "", r.w) for r in rows) == [("", 0.5), ("22", 1.0)]


def test_scale_cancels(docs):
    a, b = (
        ob.weights_vector(
            train_cg(docs, CGParams(max_iter=5, scale=s, restart_relative=True), keys=["id"]).weights
        )
        for s in (1, 0)
    )
    assert np.allclose(a, b, atol=1e-9)


def test_large_models_take_the_join_form(docs):
    with pytest.raises(ValueError):
        train_cg(docs, CGParams(max_iter=1), "packed", ["id"], packed_max_dim=10)
    a = train_cg(docs, CGParams(max_iter=1), "auto", ["id"], packed_max_dim=10)
    b = train_cg(docs, CGParams(max_iter=1), "packed", ["id"])
    assert np.allclose(ob.weights_vector(a.weights), ob.weights_vector(b.weights), atol=1e-10)


def numpy_minibatch(x, pos, neg, batch, batches, passes, inner, lam, anchor):
    w, total, done = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for _ in range(passes):
        for b in range(batches):
            m = batch == b
            xb, pb, nb = x[m], pos[m], neg[m]
            centre = w.copy() if anchor == "previous" else np.zeros_like(w)
            g_old = mu = None
            for i in range(inner):
                g = grad_of(xb, pb, nb, w) + lam * (w - centre)
                mu = -g if i == 0 else -g + (g @ g) / (mu @ (g - g_old)) * mu
                s = 1 / (1 + np.exp(-(xb @ w)))
                bend = ((pb + nb) * s * (1 - s)) @ (xb @ mu) ** 2 + lam * mu @ mu
                w = w - (g @ mu) / bend * mu
                g_old = g
            total, done = total + w, done + 1
    return total / done


@pytest.mark.parametrize("method", ["packed", "join"])
@pytest.mark.parametrize("anchor", ["previous", "zero"])
def test_minibatch_matches_numpy(docs, anchor, method):
    fit = train_cg_minibatch(
        docs,
        CGParams(max_iter=2, inner_iter=3),
        keys=["id"],
        anchor=anchor,
        batch=F.pmod("id", F.lit(3)),
        n_batches=3,
        method=method,
    )
    x, pos, neg = dense(docs)
    batch = np.array([r.id % 3 for r in docs.collect()])
    expected = numpy_minibatch(x, pos, neg, batch, 3, 2, 3, 0.1, anchor)
    assert np.allclose(ob.weights_vector(fit.weights), expected, atol=1e-8)
    trace = fit.trace.collect()
    assert len(trace) == 18
    # Weights start at zero, where each sample of the first batch costs ln 2.
    start = min(trace, key=lambda r: (r["pass"], r.batch, r.iter))
    assert start.loglik == pytest.approx(np.log(2))
    last = max(trace, key=lambda r: (r["pass"], r.batch, r.iter)).avg_objective
    assert last == pytest.approx(
        (0.05 * expected @ expected + loss_of(x, pos, neg, expected)) / 399, rel=1e-9
    )


def test_seeded_batches(docs):
    assert batch_count(2000, 1000) == 3 and batch_count(399, 1000) == 1
    a = assign_batches(docs, 4, ["id"], 1).select("id", "batch")
    assert sorted(a.collect()) == sorted(assign_batches(docs.repartition(5), 4, ["id"], 1).select("id", "batch").collect())
    assert a.select("batch").distinct().count() == 4
    assert a.exceptAll(assign_batches(docs, 4, ["id"], 2).select("id", "batch")).count() > 0
    fit = train_cg_minibatch(docs, CGParams(max_iter=1, inner_iter=1, batch_size=150), keys=["id"])
    assert fit.trace.select("batch").distinct().count() == 3


def test_weights_by_feature(spark):
    weights = ob.weights_table(spark, np.array([0.5, 1.0, 2.0, 3.0]))
    dictionary = spark.createDataFrame([(-1, 1), (0, 3)], "fid LONG, dim INT")
    rows = ev.weights_by_feature(weights, dictionary).collect()
    assert sorted((r.fid or "", r.w, r.is_bias) for r in rows) == [
        ("", 0.5, True), ("0", 3.0, False), ("18446744073709551615", 1.0, False),
    ]


def test_gradient_entries_sent_grow_with_tasks_not_partitions(spark):
    """Partial vectors are sent by merged tasks, in ranges, and meet by groups of senders."""
    d = 3 * RANGE + 17
    rows = spark.range(20_000).select(
        F.lit(1.0).alias("pos"), F.lit(2.0).alias("neg"),
        F.array(*(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(d)).cast("int") for k in range(40))).alias("idx"),
    )
    w, seen, vectors = np.zeros(d), {}, []
    for parts in (64, 256):
        with cached(pack(rows.repartition(parts, "pos", F.monotonically_increasing_id()))) as blocks:
            blocks.count()
            merged, tasks = few_tasks(blocks, 4)
            passes = ob.PackedObjective(merged, d, tasks)
            shared = spark.sparkContext.broadcast(w)
            sent = passes._partials(shared)
            seen[parts] = sent.agg(F.sum("n")).first()[0]
            assert sent.count() == 4 * 4
            summed = sum_ranges(sent, tasks, fan=2)
            assert sorted(r.key for r in summed.collect()) == [0, 1, 2, 3]
            vectors.append(collect_ranges(summed, d + 2))
            assert np.allclose(vectors[-1][:d], passes.gradient(w)[0])
    assert seen[64] == seen[256] == 4 * (d + 2)
    assert np.allclose(*vectors) and vectors[0][d + 1] == 60_000


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_sparse_and_dense_ranges_add_up(spark, kind):
    size = 5 * RANGE // 2

    def send(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                part = np.zeros(size, kind)
                part[i :: 1 + 999 * (i % 2)] = i + 1
                yield from in_ranges(part)

    parts = spark.range(9).repartition(9).mapInArrow(send, RANGES)
    summed = sum_ranges(parts, 9, kind, fan=3)
    expected = sum(np.where((np.arange(size) >= i) & ((np.arange(size) - i) % (1 + 999 * (i % 2)) == 0), i + 1, 0) for i in range(9))
    assert (collect_ranges(summed, size, kind) == expected).all()
    rows = range_entries(summed, kind).toArrow()
    assert rows.num_rows == np.count_nonzero(expected)
    assert (expected[rows.column("idx").to_numpy()] == rows.column("v").to_numpy()).all()
