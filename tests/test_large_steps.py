"""Steps that must not be made again, or grow with the input, in queries and operators."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from checks import queries
from clicktide.operators import objective as ob
from clicktide.operators.encode import encode
from clicktide.operators.histogram import last_write_request_histogram
from clicktide.sources.impressions import parse_requests


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def test_a_fit_on_clicks_encodes_once_and_scores_once(spark, small, monkeypatch):
    calls = []
    monkeypatch.setattr(queries, "encode", lambda *a, **b: calls.append(1) or encode(*a, **b))
    metrics = queries.q_cg_fit_clicks(spark, small)
    assert len(calls) == 1 and "l_orderkey" not in plan(metrics)
    assert metrics.count() == 1


def test_a_histogram_of_lines_parses_them_once(spark):
    lines = spark.createDataFrame([("9 0 11:a\t2 1 21:c\t4 0 11:c",), ("3 1 12:b",)], "value string").repartition(2)
    requests = parse_requests(lines)
    once = plan(requests).count("regexp_replace")
    counts = last_write_request_histogram(requests)
    assert once and plan(counts).count("regexp_replace") == once
    assert {r.fid: r.n for r in counts.collect()} == {11: 4, 21: 2, 12: 3}


def test_an_encoding_join_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(200).select(
        F.col("id").alias("req"), F.lit(1).alias("seg"), F.lit(2).alias("show"), F.lit(1).alias("click"),
        F.when(F.col("id") % 3 > 0, F.array("id", F.lit(7).cast("long"))).alias("feats"), F.array().cast("array<long>").alias("common"),
    )
    read = rows.mapInArrow(told, rows.schema)
    entries = spark.range(300).select(F.col("id").alias("fid"), (F.col("id") + 1).cast("int").alias("dim"), (F.col("id") == 7).cast("long").alias("n"))
    got = {r.req: r.idx for r in encode(read, entries, method="join", head_dims=1, bloom_bits=0).collect()}
    assert seen.value == 200
    assert got == {i: sorted([0, i + 1, 8]) if i % 3 else [0] for i in range(200)}


@pytest.mark.parametrize("head", [0, 3, 100])
def test_rows_of_a_margin_join_meet_in_small_parts(spark, monkeypatch, head):
    monkeypatch.setattr(ob, "PART_ROWS", 10)
    data = [(None if i % 5 == 0 else i % 7, i, 1, 2, [] if i % 11 == 0 else None if i % 13 == 0 else [0, i % 4, i, i]) for i in range(120)]
    rows = spark.createDataFrame(data, "req int, seg int, pos long, neg long, idx array<int>")
    weights = spark.createDataFrame([(i, float(i), None if i == 2 else 1.0) for i in range(100)], "idx int, w double, mu double")
    joined = ob.margins_join(rows, weights, sums={"w": "z", "mu": "xm"}, head_dims=head)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert joined.rdd.getNumPartitions() >= 12
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = {r.seg: (r.req, r.z, r.xm) for r in joined.collect()}
    for req, seg, _, _, idx in data:
        known = [i for i in idx or [] if i < 100]
        assert got[seg] == (req, float(sum(known)), float(sum(i != 2 for i in known)))
    assert len(got) == len(data)
