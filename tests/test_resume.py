"""Fits that go on from storage: block stores, saved rounds, batches with files of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.fixtures import document_examples
from clicktide.operators import objective as ob
from clicktide.operators.tiles import in_tiles
from clicktide.plans import minibatch
from clicktide.plans.cg import TRACE_SCHEMA, train_cg, train_store
from clicktide.plans.minibatch import train_cg_minibatch
from clicktide.plans.params import CGParams
from clicktide.plans.rounds import Rounds, vector_arrays, vector_ranges
from clicktide.session import ensure_checkpoint_dir, names_in
from clicktide.sources.blockstore import BlockStore, write_store


@pytest.fixture(scope="module")
def docs(spark):
    return document_examples(spark, "/root/testdata/sf0.01").persist()


@pytest.fixture
def place(spark, tmp_path):
    return f"file://{tmp_path}"


def rows(fit):
    return np.array(fit.trace.drop("rtime").orderBy("iter").collect(), float)


@pytest.mark.parametrize("first, second", [("packed", "packed"), ("join", "join"), ("packed", "join"), ("join", "packed")])
def test_a_stopped_fit_goes_on(spark, docs, place, first, second):
    whole = train_cg(docs, CGParams(max_iter=4), "packed")
    train_cg(docs, CGParams(max_iter=2), first, rounds_at=place)
    fit = train_cg(docs, CGParams(max_iter=4), second, rounds_at=place)
    assert np.allclose(rows(fit), rows(whole), rtol=1e-7, atol=1e-9)
    assert np.allclose(ob.weights_vector(fit.weights), ob.weights_vector(whole.weights), atol=1e-9)
    # The last round and the one before it are kept, and a finished fit makes no round again.
    assert sorted(names_in(spark, place)) == ["round-000002", "round-000003"]
    again = train_cg(docs, CGParams(max_iter=4), second, rounds_at=place)
    assert (rows(again) == rows(fit)).all()
    assert np.allclose(ob.weights_vector(again.weights), ob.weights_vector(fit.weights), atol=1e-12)


def test_another_fit_does_not_go_on(docs, place):
    train_cg(docs, CGParams(max_iter=1), rounds_at=place)
    with pytest.raises(ValueError, match="lam"):
        train_cg(docs, CGParams(max_iter=2, lam=0.5), rounds_at=place)
    with pytest.raises(ValueError, match="with n"):
        train_cg(docs.limit(100), CGParams(max_iter=2), rounds_at=place)


def test_a_fit_that_met_its_bound_stays(docs, place):
    a = train_cg(docs, CGParams(max_iter=9, eps=0.36), rounds_at=place)
    for method in ("packed", "join"):
        b = train_cg(docs, CGParams(max_iter=9, eps=0.36), method, rounds_at=place)
        assert a.trace.count() == b.trace.count() < 9
        assert np.allclose(ob.weights_vector(a.weights), ob.weights_vector(b.weights), atol=1e-12)


def test_unfinished_rounds_do_not_count(spark, place):
    saved = Rounds(spark, place, TRACE_SCHEMA, {"lam": 0.1})
    assert saved.last() is None
    trace = [dict.fromkeys((c.split()[0] for c in TRACE_SCHEMA.split(", ")), 0.5) | {"iter": 0}]
    w = np.arange(11.0)
    saved.save(0, vector_ranges(spark, w, w + 1, w + 2, columns=4), trace)
    vector_ranges(spark, w, w, w).write.parquet(f"{place}/round-000001/vectors")
    assert saved.last() == 0
    vectors, got = saved.load(0)
    assert got == trace and vectors.count() == 3
    assert all((a == b).all() for a, b in zip(vector_arrays(vectors), (w, w + 1, w + 2)))
    saved.save(1, vector_ranges(spark, w, w, w), trace)
    assert saved.last() == 1


def test_a_store_is_all_that_a_fit_needs(spark, docs, place):
    expected = train_cg(docs, CGParams(max_iter=2), "packed")
    write_store(docs, f"{place}/store")
    store = BlockStore(spark, f"{place}/store")
    assert (store.n, store.d) == (expected.n, expected.d)
    for method in ("auto", "packed", "join"):
        fit = train_store(store, CGParams(max_iter=2), method)
        assert np.allclose(rows(fit), rows(expected), rtol=1e-7, atol=1e-9)
    assert "sizes" in store.blocks.columns and "batch" not in store.blocks.columns
    tiles = in_tiles(store.blocks)
    assert (tiles.n, tiles.d) == (store.n, store.d)
    tiles.drop()
    with pytest.raises(ValueError):
        train_store(store, CGParams(max_iter=1), "packed", packed_max_dim=3)
    # A store that was not finished has no manifest.
    write_store(docs, f"{place}/half")
    from clicktide.session import drop_path

    drop_path(spark, f"{place}/half/manifest")
    with pytest.raises(Exception, match="manifest"):
        BlockStore(spark, f"{place}/half")


def test_a_batch_starts_its_own_tasks_only(spark, docs, place):
    many = docs.repartition(6).unionByName(docs).unionByName(docs)
    store = write_store(many, place, 12, seed=3, pieces=2)
    alone = [store.batch(b) for b in range(12)]
    assert sum(part.agg(F.sum("n")).first()[0] for part in alone) == store.n == 3 * 399
    files = {b: {r[0] for r in part.select(F.input_file_name()).distinct().collect()} for b, part in enumerate(alone)}
    assert all(files.values()) and len(set.union(*files.values())) == sum(map(len, files.values()))
    plan = alone[3]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan
    assert alone[3].rdd.getNumPartitions() <= 2 < store.blocks.rdd.getNumPartitions()


def test_rows_with_null_or_equal_keys_spread_over_batches(spark, place):
    rows = spark.range(1000).select(
        F.lit(None).cast("long").alias("req"), F.lit(1).alias("seg"), F.lit(1).alias("pos"), F.lit(0).alias("neg"),
        F.array(F.lit(0)).alias("idx"),
    )
    sizes = {r.batch: r.n for r in write_store(rows, place, 10, seed=1).manifest.collect()}
    assert sorted(sizes) == list(range(10)) and all(50 < n < 160 for n in sizes.values())
    fit = train_cg_minibatch(rows, CGParams(max_iter=1, inner_iter=1), n_batches=4, seed=2)
    assert fit.trace.select("batch").distinct().count() == 4


def test_the_seed_repeats_batches_and_an_empty_one_is_no_step(spark, docs):
    params = CGParams(max_iter=1, inner_iter=2)
    fits = [train_cg_minibatch(docs, params, n_batches=3, seed=s, track_objective=False) for s in (1, 1, 2)]
    w = [ob.weights_vector(f.weights) for f in fits]
    assert np.allclose(w[0], w[1], atol=1e-12) and not np.allclose(w[0], w[2], atol=1e-6)
    # All rows in batch 1 of 3, with a spread over several pieces.
    one = [
        train_cg_minibatch(docs, params, batch=F.lit(1), n_batches=3, anchor=a, method=m)
        for m in ("packed", "join") for a in ("previous", "zero")
    ]
    w = [ob.weights_vector(f.weights) for f in one]
    assert np.allclose(w[0], w[2], atol=1e-9) and np.allclose(w[1], w[3], atol=1e-9)


def test_stores_of_batches_are_dropped(spark, docs, monkeypatch):
    monkeypatch.setattr(minibatch, "ROWS_PER_PIECE", 50)
    before = {n for n in names_in(spark, ensure_checkpoint_dir(spark)) if n.startswith("store-")}
    train_cg_minibatch(docs, CGParams(max_iter=1, inner_iter=1), n_batches=2)
    assert {n for n in names_in(spark, ensure_checkpoint_dir(spark)) if n.startswith("store-")} == before
