import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktide.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, most=16, count=False):
    """{row place: (n, [deviation], whitened rows, explained)} by numpy and exact integers."""
    good = [
        (i, [math.floor(64 * c) + 1_000_000 for c in v])
        for i, v in rows
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]
    x = [tuple(v) for _, v in good] if count else sorted({tuple(v) for _, v in good})
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    centred = np.array([[float(v[j]) - sums[j] / n for j in range(d)] for v in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    out = []
    for i, v in good:
        z = (np.array([v[j] - sums[j] / n for j in range(d)]) @ u) / np.sqrt(e)
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), z, e / np.trace(cov)))
    return out


def check(got, expected, tol=1e-7):
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), []).append(r)
    assert sum(len(v) for v in by_row.values()) == sum(len(z) for _, _, _, z, _ in expected)
    signs = {}
    for i, n, deviation, z, explained in expected:
        rows = by_row[i, deviation]
        for c in range(len(z)):
            found = [r for r in rows if r.component == c + 1]
            assert found and all(r.n == n for r in found)
            assert all(abs(r.explained - explained[c]) <= 1e-10 for r in found)
            r = found[0]
            sign = signs.setdefault(c, 1.0 if r.whitened * z[c] >= 0 else -1.0)
            if abs(z[c]) > 1e-6 and abs(sign * r.whitened - z[c]) > tol:
                raise AssertionError((i, c, r.whitened, z[c]))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(20)]) for i in range(200)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(150)]
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[4][1])]
    rows += [(-1, None), (-2, []), (-3, [None] * 20), (-4, [float("nan")] * 20), (-5, [float("inf")] + [0.0] * 19)]
    return rows


@pytest.mark.parametrize("hot", [50, 10**6])
def test_against_brute_force(spark, vectors, hot):
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], SCHEMA).repartition(5)
    for name in ("n", "_x", "copies", "component", "whitened", "_name", "deviation"):
        table = table.withColumn(name, F.lit("clash"))
    got = wh.whiten(table, hot_copies=hot).collect()
    check(got, brute(vectors))
    # Rows that repeat, and a null id, have rows of their own.
    assert sum(r.vec_id == 5 and r.component == 1 for r in got) == 3
    assert sum(r.vec_id is None for r in got) == 16


def test_counts_as_weights(spark, vectors):
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], SCHEMA)
    check(wh.whiten(table, weights="count").collect(), brute(vectors, count=True))


def test_small_and_flat_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    empty = wh.whiten(make([]))
    assert empty.count() == 0 and empty.columns[:2] == ["vec_id", "component"]
    assert wh.whiten(make([(1, None), (2, [])])).count() == 0
    same = wh.whiten(make([(1, [1.0, 2.0]), (2, [1.001, 2.001])])).collect()
    assert len(same) == 4 and all(r.whitened is None and r.deviation == 0 and r.n == 1 for r in same)
    line = wh.whiten(make([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and len(line) == 30
    with pytest.raises(ValueError, match="entries"):
        wh.whiten(make([(1, [1.0]), (2, [1.0, 2.0])]))


def test_sums_and_deviations_are_exact_in_longs(spark):
    """Values that overflow a long on the way, and deviations that no long can hold."""
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40 + 2.0**24, 1.0]), (2, [3e300, -3e300]), (3, [0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = {r.vec_id: r for r in wh.whiten(table.filter("vec_id < 2")).collect() if r.component == 1}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows[:2]]
    sums = [sum(c) for c in zip(*x)]
    assert {i: got[i].deviation for i in got} == {
        i: sum((2 * c - s) ** 2 for c, s in zip(x[i], sums)) for i in range(2)
    }
    assert {r.deviation for r in wh.whiten(table).collect()} == {None}


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    check(wh.op12_whitening(spark, small).collect(), brute([(r.vec_id, r.embedding) for r in rows]), 1e-6)
