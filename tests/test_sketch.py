"""Summaries that keep ids out of shuffles: exact results, few ids moved, time in proportion."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.fixtures import impressions
from clicktide.operators import histogram as hg, sketch as sk
from clicktide.operators.encode import _looked_up, _sorted_entries, combine_segments, encode
from clicktide.plans import jobs

SCHEMA = "req LONG, seg INT, show INT, click INT, feats ARRAY<LONG>, common ARRAY<LONG>"


@pytest.fixture(scope="module")
def skewed(spark):
    """60,000 rare ids, 40 frequent ones, NULL ids, lists and shows."""
    ids = F.array(
        F.when(F.col("id") % 11 > 0, F.col("id") % 40 + 1_000_000), F.col("id") - 20_000,
        (F.col("id") * 7919) % 60_000 + 2**60,
    )
    return spark.range(0, 30_000, 1, 6).select(
        F.col("id").alias("req"), F.lit(1).alias("seg"), F.when(F.col("id") % 17 > 0, (F.col("id") % 3).cast("int")).alias("show"),
        F.lit(0).alias("click"), F.when(F.col("id") % 13 > 0, ids).alias("feats"), F.array(F.lit(-5).cast("long")).alias("common"),
    )


def test_sketch_bounds_from_above(skewed):
    exact = {r.fid: r.n or 0 for r in hg.feature_histogram(skewed).collect()}
    sketch = sk.exposure_sketch(skewed, width=1 << 12, tasks=3)
    ids = np.array(list(exact))
    bound, n = sketch.bound(ids), np.array(list(exact.values()))
    assert (bound >= n).all() and (bound == n).mean() < 1
    assert sketch.table.sum(axis=1).tolist() == [n.sum()] * sk.DEPTH
    assert (bound - n).mean() < 3 * n.sum() / (1 << 12)


def test_rare_ids_do_not_leave_their_task(skewed):
    threshold = 200
    sketch = sk.exposure_sketch(skewed)
    moved = sk.possible_counts(skewed, sketch, threshold)
    exact = hg.frequent(hg.feature_histogram(skewed), threshold)
    want = sorted(exact.collect())
    assert sorted(hg.frequent_sketched(skewed, threshold).collect()) == want and len(want) == 41
    plain = skewed.select(F.spark_partition_id().alias("p"), F.explode_outer(F.concat("feats", "common")).alias("fid"))
    before, after = plain.distinct().count(), moved.count()
    assert {r.fid for r in moved.select("fid").distinct().collect()} == {r.fid for r in want}
    assert after <= 41 * 60 and before > 40_000
    text = hg.frequent_sketched(skewed, threshold)._jdf.queryExecution().toString()
    assert "MapInArrow" in text


def test_a_full_sketch_changes_the_way_and_not_the_result(skewed):
    want = sorted(hg.frequent(hg.feature_histogram(skewed), 10).collect())
    crowded = hg.frequent_sketched(skewed, 10, width=64)
    assert "MapInArrow" not in crowded._jdf.queryExecution().toString()
    assert sorted(crowded.collect()) == want == sorted(hg.frequent_sketched(skewed, 10, tasks=1).collect())


def test_sketched_dictionary(spark, small, skewed):
    imps = impressions(spark, small)
    assert sorted(jobs.build_dictionary(imps, 60, sketched=True).collect()) == sorted(jobs.build_dictionary(imps, 60).collect())
    assert jobs.build_dictionary(skewed.limit(0), 1, sketched=True).count() == 0
    with pytest.raises(ValueError):
        jobs.build_dictionary(imps, 60, hg.last_write_histogram, sketched=True)
    with pytest.raises(Exception, match="negative"):
        sk.exposure_sketch(skewed.withColumn("show", F.lit(-1)))


def test_bloom_filter_lets_all_of_its_ids_pass_and_few_others(spark):
    known = spark.range(50_000).select((F.col("id") * 977 - 2**40).alias("fid")).repartition(5)
    bloom = sk.bloom_filter(known, 50_000)
    ids = np.arange(50_000, dtype=np.int64) * 977 - 2**40
    assert bloom.may_hold(ids).all()
    assert bloom.may_hold(ids + 1).mean() < 0.02
    # With fewer bits it lets more pass, and still holds none of its own back.
    small = sk.bloom_filter(known, 50_000, most_bits=1 << 17)
    assert small.may_hold(ids).all() and len(small.words) == 1 << 11
    assert not sk.bloom_filter(known.limit(0), 0).may_hold(ids).any()


def test_unknown_ids_are_not_moved(spark, skewed):
    dictionary = spark.createDataFrame([(1_000_000 + i, i + 1) for i in range(40)] + [(2**60 + 7, 41)], "fid LONG, dim INT")
    rows = combine_segments(skewed).select("req", "fids")
    head, tail = dictionary.filter("dim <= 40"), dictionary.filter("dim > 40")
    known = _sorted_entries(head.toArrow())
    count = lambda others: _looked_up(rows, known, others).agg(F.sum(F.size("_rest"))).first()[0]
    with_all, filtered = count(None), count(sk.bloom_filter(tail, 1))
    held = rows.select(F.explode("fids").alias("f")).filter(F.col("f") == 2**60 + 7).count()
    assert held >= 1 and held <= filtered < 0.2 * with_all
    got = [
        sorted((r.req, r.idx) for r in encode(skewed, dictionary, method="join", head_dims=h, bloom_bits=b).collect())
        for h, b in ((40, 16), (40, 0), (0, 1), (100, 16))
    ]
    assert got[0] == sorted((r.req, r.idx) for r in encode(skewed, dictionary).collect())
    assert all(g == got[0] for g in got)


def replacing(segs):
    """Counts of a line, slot by slot."""
    slots = segs[1:] if len(segs) > 1 else segs
    common = segs[0][2:] if len(segs) > 1 else []
    counts = {}
    for slot in slots:
        for fid in common:
            counts[fid] = counts.get(fid, 0) + slot[0]
        for fid in slot[2:]:
            counts[fid] = slot[0]
    return counts


def test_long_lines_take_time_in_proportion(spark):
    """Features both shared and owned, in lines of up to 50,000 slots."""
    rng = np.random.default_rng(8)

    def line(slots, ids=2000):
        shared = rng.integers(0, ids, 500).tolist()
        return [[0, 0, *shared], *([int(rng.integers(0, 5)), 0, *rng.integers(0, ids, 2).tolist()] for _ in range(slots))]

    lines = [line(5, 8), line(40, 30), [[3, 1, 7, 7, 8]], [[0, 0, 1, 1]], line(300)]
    table = lambda ls: spark.createDataFrame([(s,) for s in ls], "segs ARRAY<ARRAY<LONG>>")
    expected = {}
    for segs in lines:
        for fid, n in replacing(segs).items():
            expected[fid] = expected.get(fid, 0) + n
    odd = table(lines).unionByName(spark.createDataFrame([(None,)], "segs ARRAY<ARRAY<LONG>>"))
    for rows in (odd.repartition(1), odd.repartition(4)):
        got = {r.fid: r.n for r in hg.last_write_request_histogram(rows).collect()}
        assert got == expected
    seconds = {}
    for slots in (5_000, 50_000):
        one = table([line(slots)]).persist()
        one.count()
        began = time.monotonic()
        hg.last_write_request_histogram(one).agg(F.sum("n")).first()
        seconds[slots] = time.monotonic() - began
    assert seconds[50_000] < 10 * seconds[5_000] + 2
