import pytest
from pyspark.sql import functions as F

from clicktide.functions.numbering import number_rows, number_within
from clicktide.functions.scalar import format_unsigned, parse_unsigned, sigmoid
from clicktide.operators.encode import encode, fits_broadcast
from clicktide.operators.histogram import frequent, number_features
from clicktide.operators.samples import count_samples, expanded_samples, weighted_samples
from clicktide.operators.stats import data_stats, dictionary_dim
from clicktide.sources.impressions import parse_impressions

LOG = [
    "3 1 11:a 12:b",
    "9 0 11:a\t2 1 21:c\t4 0 22:c",
    "1 0 11:a 11:a\t5 0 21:c",
    "2 5 11:a",
    "0 0 11:a",
    "1 1 999:z",
    "1 -1 18446744073709551615:a 11:b",
]
DICT = [(11, 4), (12, 2), (21, 1), (-1, 3)]
EXPECTED = {
    (0, 1): (1, 2, [0, 2, 4]),
    (1, 1): (1, 1, [0, 1, 4]),
    (1, 2): (0, 4, [0, 4]),
    (2, 1): (0, 5, [0, 1, 4, 4]),
    (3, 1): (2, 0, [0, 4]),
    (4, 1): (0, 0, [0, 4]),
    (5, 1): (1, 0, [0]),
    (6, 1): (0, 1, [0, 3, 4]),
}


@pytest.fixture(scope="module")
def imps(spark):
    return parse_impressions(
        spark.createDataFrame(list(enumerate(LOG)), "req LONG, value STRING")
    ).cache()


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(DICT, "fid LONG, dim INT")


@pytest.mark.parametrize("method", ["broadcast", "join", "auto"])
@pytest.mark.parametrize("parts", [1, 5])
def test_encode(imps, dictionary, method, parts):
    rows = encode(imps.repartition(parts), dictionary, method=method).collect()
    assert {(r.req, r.seg): (r.pos, r.neg, r.idx) for r in rows} == EXPECTED


def test_encode_with_empty_dictionary(imps, dictionary):
    for method in ("broadcast", "join"):
        rows = encode(imps, dictionary.filter("false"), method=method).collect()
        assert len(rows) == len(EXPECTED) and all(r.idx == [0] for r in rows)


def test_dictionary_size_decides(imps, dictionary):
    assert fits_broadcast(dictionary, 4) and not fits_broadcast(dictionary, 3)
    with pytest.raises(ValueError):
        encode(imps, dictionary, method="broadcast", max_entries=3)
    for entries, joined in ((3, True), (4, False)):
        plan = encode(imps, dictionary, max_entries=entries, head_dims=1)._jdf.queryExecution().toString()
        assert ("Join" in plan) == joined


@pytest.mark.parametrize("head", [0, 2, 3, 100])
def test_encode_with_head_and_tail(imps, dictionary, head):
    rows = encode(imps, dictionary, method="join", head_dims=head).collect()
    assert {(r.req, r.seg): (r.pos, r.neg, r.idx) for r in rows} == EXPECTED


@pytest.mark.parametrize("method, head", [("broadcast", 0), ("join", 0), ("join", 1), ("join", 100)])
def test_forms_agree_on_odd_rows(spark, method, head):
    big = 2**60
    rows = [
        (None, 1, 2, 1, [big + 3, None], [7]), (1, 1, 1, 0, [big + 1], []), (1, 1, 1, 0, [5], [7, 7]),
        (2, 1, 1, 1, [], []), (3, 1, 1, 1, None, [5]), (4, 1, 1, 0, [99], [98]),
    ]
    imps = spark.createDataFrame(
        rows, "req LONG, seg INT, show INT, click INT, feats ARRAY<LONG>, common ARRAY<LONG>"
    )
    dictionary = spark.createDataFrame([(big + 1, 1), (5, 2), (7, 3)], "fid LONG, dim INT")
    got = encode(imps, dictionary, method=method, head_dims=head).collect()
    assert sorted(((r.req, r.pos, r.neg, r.idx) for r in got), key=repr) == sorted(
        [(None, 1, 1, [0, 3]), (1, 0, 1, [0, 1]), (1, 0, 1, [0, 2, 3, 3]), (2, 1, 0, [0]), (3, 1, 0, [0, 2]), (4, 0, 1, [0])],
        key=repr,
    )


@pytest.mark.parametrize("method", ["broadcast", "join"])
def test_repeated_feature_ids_fail(imps, spark, method):
    twice = spark.createDataFrame([(11, 1), (11, 2)], "fid LONG, dim INT")
    with pytest.raises(ValueError, match="repeated feature ids"):
        encode(imps, twice, method=method)


def test_hot_features_are_in_the_head_whatever_their_dim(spark):
    from clicktide.operators.encode import most_frequent

    rows = spark.createDataFrame([([9, 1],), ([9, 2],), ([9, 3],), ([9, 4],)], "fids ARRAY<LONG>")
    dictionary = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (9, 5)], "fid LONG, dim INT")
    head, tail = most_frequent(rows, dictionary, 1)
    assert [r.fid for r in head.collect()] == [9] and tail.count() == 4


def test_negative_show_fails(spark, dictionary):
    bad = parse_impressions(spark.createDataFrame([(0, "-1 0 11")], "req LONG, value STRING"))
    with pytest.raises(Exception, match="negative number of shows"):
        encode(bad, dictionary).collect()


def test_samples(imps, dictionary):
    examples = encode(imps, dictionary)
    weighted = weighted_samples(examples)
    expanded = expanded_samples(examples)
    assert weighted.filter("wt <= 0").count() == 0
    a = weighted.groupBy("req", "seg", "y").agg(F.sum("wt").alias("n"))
    b = expanded.groupBy("req", "seg", "y").agg(F.count("*").alias("n"))
    assert sorted(a.collect()) == sorted(b.collect())
    back = count_samples(weighted.select("req", "seg", "y", "wt", "idx"))
    assert back.agg(F.sum("pos"), F.sum("neg")).first() == (5, 13)
    assert [r.y for r in expanded.filter("req = 0").orderBy("k").collect()] == [1.0, -1.0, -1.0]
    stats = data_stats(examples).first()
    assert (stats.n, stats.d) == (18, 5)
    assert dictionary_dim(dictionary).first().dict_d == 5
    assert data_stats(examples.filter("false")).first().d is None


def test_expansion_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("clicktide.operators.samples.EXPAND_PIECE", 4)
    for pos, neg in ((3, 7), (0, 4), (5, 0), (9, 1)):
        rows = spark.createDataFrame([(1, pos, neg)], "id LONG, pos LONG, neg LONG")
        got = [(r.k, r.y) for r in expanded_samples(rows).orderBy("k").collect()]
        assert got == [(k, 1.0 if k <= pos else -1.0) for k in range(1, pos + neg + 1)]


def test_other_labels_fail(spark):
    rows = spark.createDataFrame([(0.0, [0])], "y DOUBLE, idx ARRAY<INT>")
    with pytest.raises(Exception, match="label must be"):
        count_samples(rows).collect()


def test_unsigned(spark):
    texts = ["0", "5", "+5", "00011", str(2**63 - 1), str(2**63), str(2**64 - 1)]
    bad = [str(2**64), "-1", "abc", "12x", "1.5", "", "1e3", " 5"]
    rows = (
        spark.createDataFrame([(t,) for t in texts + bad], "t STRING")
        .select("t", parse_unsigned(F.col("t")).alias("b"))
        .withColumn("u", format_unsigned(F.col("b")))
        .collect()
    )
    for r in rows:
        assert r.u == (str(int(r.t)) if r.t in texts else None)
    assert {r.t: r.b for r in rows}[str(2**64 - 1)] == -1


def test_sigmoid_keeps_tail(spark):
    row = spark.range(1).select(
        sigmoid(F.lit(-50.0)).alias("a"), sigmoid(F.lit(0.0)).alias("b"), sigmoid(F.lit(800.0)).alias("c")
    ).first()
    assert 1e-22 < row.a < 2e-22 and row.b == 0.5 and row.c == 1.0


def test_dictionary_numbering(spark):
    hist = spark.range(1000).select(F.col("id").alias("fid"), (F.col("id") % 37).alias("n"))
    rows = number_features(frequent(hist, 5)).collect()
    expected = sorted(((i % 37, i) for i in range(1000) if i % 37 > 5), key=lambda t: (-t[0], t[1]))
    assert [(r.n, r.fid) for r in sorted(rows, key=lambda r: r.dim)] == expected
    assert sorted(r.dim for r in rows) == list(range(1, len(expected) + 1))
    assert number_features(hist.filter("false")).count() == 0


def test_numbering_inside_hot_groups(spark):
    # One group holds a third of the rows and more.
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 50).alias("g"),
        F.pmod(F.col("id") * 7919, F.lit(10007)).alias("o"),
        "id",
    )
    plain = number_within(rows, ["g"], ["o"], "k")
    split = number_within(rows, ["g"], ["o"], "k", hot_rows=100)
    assert sorted(plain.collect()) == sorted(split.select(plain.columns).collect())


def test_number_rows_with_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = number_rows(spark.range(5000), [F.col("id").desc()], "k").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r.k == 5000 - r.id for r in rows) and len(rows) == 5000
