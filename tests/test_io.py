"""Files in and out, and the whole path from log to exported model."""

import pytest

from checks.fixtures import impressions, log_lines
from clicktide.operators.encode import encode
from clicktide.operators.histogram import feature_histogram, last_write_histogram
from clicktide.operators.samples import expanded_samples
from clicktide.plans import jobs
from clicktide.plans.params import CGParams
from clicktide.sources import sinks
from clicktide.sources.dictionary import load_dictionary, load_reverse_dictionary
from clicktide.sources.impressions import read_impressions
from clicktide.sources.libsvm import read_examples


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_libsvm_style(spark, tmp_path):
    (tmp_path / "a").write_text("+1 1:0.7 2:1\t5:9\n\n  -1 3:0 3:1  \n-1\n")
    rows = read_examples(spark, str(tmp_path), 2).collect()
    assert sorted((r.y, r.idx) for r in rows) == [(-1.0, [0]), (-1.0, [0, 3, 3]), (1.0, [0, 1, 2, 5])]


def test_dictionary_files(spark, tmp_path):
    text = "11 1\n12 2 x\n18446744073709551615 3\n\n11 4\n13 1\njunk\n"
    (tmp_path / "d").write_text(text)
    forward = load_dictionary(spark, str(tmp_path)).collect()
    assert {r.fid: r.dim for r in forward} == {11: 4, -1: 3, 13: 1}
    backward = load_reverse_dictionary(spark, str(tmp_path)).collect()
    assert {r.dim: r.fid for r in backward} == {1: 13, 3: -1, 4: 11}
    (tmp_path / "d").write_text("abc 1\n")
    with pytest.raises(Exception, match="malformed feature id"):
        load_dictionary(spark, str(tmp_path)).collect()


def test_dictionary_last_line_wins_across_blocks(spark, tmp_path):
    (tmp_path / "d").write_text("".join(f"{i % 100} {i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = load_dictionary(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.fid: r.dim for r in rows} == {i: 19900 + i for i in range(100)}


def test_log_to_model(spark, small, tmp_path):
    imps = impressions(spark, small)
    log = str(tmp_path / "log")
    log_lines(imps).select("value").write.text(log)
    read = read_impressions(spark, log)
    assert read.count() == imps.count()
    hist = feature_histogram(read)
    assert sorted(hist.collect()) == sorted(feature_histogram(imps).collect())

    dictionary = jobs.build_dictionary(read, 60)
    assert sorted(dictionary.collect()) == sorted(jobs.build_dictionary(imps, 60).collect())
    sinks.write_dictionary(dictionary, str(tmp_path / "dict"), "text")
    sinks.write_histogram(dictionary, str(tmp_path / "dict_his"), "text")
    loaded = load_dictionary(spark, str(tmp_path / "dict"))
    assert sorted(loaded.collect()) == sorted(dictionary.select("fid", "dim").collect())
    top = dictionary.orderBy("dim").first()
    assert text_of(tmp_path / "dict").splitlines()[0] == f"{top.fid} 1"
    assert f"{top.fid} {top.n}" in text_of(tmp_path / "dict_his").splitlines()

    trained = jobs.fit(read, loaded, CGParams(max_iter=3))
    metrics = trained.metrics.first()
    assert 0 <= metrics.accuracy <= 1 and 0 <= metrics.auc <= 1
    again = jobs.test(imps, loaded, trained.fit.weights).first()
    assert again.accuracy == pytest.approx(metrics.accuracy)
    assert again.auc == pytest.approx(metrics.auc, abs=1e-9)
    join = jobs.fit(read, loaded, CGParams(max_iter=3), "join").metrics.first()
    assert join.auc == pytest.approx(metrics.auc, abs=1e-6)

    jobs.export_model(trained.fit.weights, loaded, str(tmp_path / "out"), "text")
    weights = [float(v) for v in text_of(tmp_path / "out" / "model").split()]
    expected = [r.w for r in trained.fit.weights.orderBy("idx").collect()]
    assert weights == expected
    named = dict(v.split() for v in text_of(tmp_path / "out" / "modelMap").splitlines())
    assert len(named) == trained.fit.d and float(named["0"]) == expected[0]
    assert float(named[str(top.fid)]) == expected[1]
    jobs.export_model(trained.fit.weights, loaded, str(tmp_path / "out2"))
    assert spark.read.parquet(str(tmp_path / "out2" / "model")).count() == trained.fit.d

    sinks.write_trace(trained.fit.trace, str(tmp_path / "trace"), "text")
    alphas = [float(v) for v in text_of(tmp_path / "trace" / "alpha").split()]
    assert alphas == [r.alpha for r in trained.fit.trace.orderBy("iter").collect()]
    sinks.write_trace(trained.fit.trace, str(tmp_path / "trace2"))
    assert spark.read.parquet(str(tmp_path / "trace2")).count() == 3

    samples = expanded_samples(encode(read, loaded))
    sinks.write_samples(samples.select("y", "idx"), str(tmp_path / "samples"), "text")
    blocks = text_of(tmp_path / "samples").strip("\n").split("\n\n")
    assert len(blocks) == samples.count() == trained.fit.n
    label, indices = blocks[0].split("\n")
    assert label in ("1.0", "-1.0") and indices.startswith("0")

    other = jobs.build_dictionary(read, 60, last_write_histogram)
    assert other.count() > 0


def test_narrow_steps_accept_streams(spark, small, tmp_path):
    log = str(tmp_path / "log")
    log_lines(impressions(spark, small)).select("req", "value").write.parquet(log)
    dictionary = jobs.build_dictionary(impressions(spark, small), 60)
    lines = spark.readStream.schema("req LONG, value STRING").parquet(log)
    from clicktide.sources.impressions import parse_impressions

    encoded = encode(parse_impressions(lines), dictionary)
    query = (
        encoded.writeStream.format("memory").queryName("encoded").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert spark.table("encoded").count() == impressions(spark, small).count()


def test_text_formats_only(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_weights(spark.range(1).selectExpr("0 idx", "0.0 w"), str(tmp_path / "x"), "csv")
