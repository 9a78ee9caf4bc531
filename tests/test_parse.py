"""Log grammar, edge cases and parse modes, against a line-by-line reading in plain Python."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from clicktide.operators.histogram import (
    feature_histogram,
    last_write_histogram,
    last_write_request_histogram,
)
from clicktide.sources.impressions import (
    explode_slots,
    parse_impressions,
    parse_requests,
    read_impressions,
)

GOOD = {
    "3 1 11:a 12:b": [(1, 3, 1, [11, 12], [])],
    "9 0 11:a\t2 1 21:c\t4 0 22:c": [(1, 2, 1, [21], [11]), (2, 4, 0, [22], [11])],
    "1 0 11:a 11:a\t5 0 21:c": [(1, 5, 0, [21], [11, 11])],
    "2 5 11:a": [(1, 2, 5, [11], [])],
    "0 0 11:a": [(1, 0, 0, [11], [])],
    "1 0 18446744073709551615:a 9223372036854775808:b": [(1, 1, 0, [-1, -(2**63)], [])],
    "1 0 11:a\t\t": [(1, 1, 0, [11], [])],
    "1 0 11:a  \t2 0 12": [(1, 2, 0, [12], [11])],
    "+1 -2 +11:a 12: 13:x:y": [(1, 1, -2, [11, 12, 13], [])],
    "4 2": [(1, 4, 2, [], [])],
    "-7 0 5:a\t1 1 6:b": [(1, 1, 1, [6], [5])],
}
BAD = [
    "x 0 11:a", "", "1", "1 0 :a", "1 0 -5:a", "1 0 -0:a", "1  0 11:a", " 1 0 11:a", "1 0 1e3:a",
    "1 0 1.5:a", "1 0 18446744073709551616:a", "1 0 11:a\t\t2 0 12:a", "3000000000 0 11:a",
    "1 0 11:a\t2", "1 0 +:a", "\t", "1 0 11:a\tx 0 12:b",
]


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "req LONG, value STRING")


def test_good_lines(spark):
    rows = parse_impressions(lines(spark, list(GOOD))).orderBy("req", "seg").collect()
    got = {}
    for r in rows:
        got.setdefault(r.req, []).append((r.seg, r.show, r.click, r.feats, r.common))
    assert [got.get(i, []) for i in range(len(GOOD))] == list(GOOD.values())


@pytest.mark.parametrize("text", BAD)
def test_failfast_stops(spark, text):
    with pytest.raises(Exception, match="malformed impression line"):
        parse_impressions(lines(spark, ["1 0 11:a", text])).count()


def test_other_modes(spark):
    mixed = lines(spark, ["1 0 11:a", *BAD, "2 0 12:a"])
    dropped = parse_impressions(mixed, "DROPMALFORMED").collect()
    assert [(r.req, r.show) for r in dropped] == [(0, 1), (len(BAD) + 1, 2)]
    kept = parse_requests(mixed, "PERMISSIVE")
    corrupt = kept.filter("_corrupt_record is not null").orderBy("req").collect()
    assert [r._corrupt_record for r in corrupt] == BAD
    assert all(r.segs is None for r in corrupt)
    assert explode_slots(kept).count() == 2


def test_read_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(GOOD) + "\n")
    rows = read_impressions(spark, str(tmp_path), min_partitions=3)
    assert rows.rdd.getNumPartitions() >= 3
    assert rows.count() == sum(map(len, GOOD.values()))


def replay(texts):
    """The two counting rules, line by line."""
    plain, replacing = {}, {}
    for text in texts:
        segs = [s.split(" ") for s in text.split("\t")]
        shared, slots = (segs[0][2:], segs[1:]) if len(segs) > 1 else ([], segs)
        line = {}
        for seg in slots:
            show = int(seg[0])
            for f in shared:
                line[f] = line.get(f, 0) + show
            for f in seg[2:]:
                line[f] = show
            for f in shared + seg[2:]:
                plain[int(f)] = plain.get(int(f), 0) + show
        for f, n in line.items():
            replacing[int(f)] = replacing.get(int(f), 0) + n
    return plain, replacing


def random_line(rng):
    def seg():
        ids = [str(rng.randint(1, 6)) for _ in range(rng.randint(0, 5))]
        return " ".join([str(rng.randint(0, 5)), "0", *ids])

    return "\t".join(seg() for _ in range(rng.randint(1, 5)))


def as_dict(df):
    rows = df.collect()
    out = {r.fid: r.n for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_histograms_match_replay(spark, seed):
    rng = random.Random(seed)
    texts = [random_line(rng) for _ in range(800)]
    plain, replacing = replay(texts)
    requests = parse_requests(lines(spark, texts)).cache()
    imps = explode_slots(requests)
    assert as_dict(feature_histogram(imps)) == plain
    assert as_dict(last_write_histogram(imps)) == replacing
    assert as_dict(last_write_request_histogram(requests)) == replacing


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 2**32), min_size=1, max_size=5))
def test_replacing_rule_property(spark, seeds):
    texts = [random_line(random.Random(s)) for s in seeds]
    requests = parse_requests(lines(spark, texts))
    _, replacing = replay(texts)
    assert as_dict(last_write_request_histogram(requests)) == replacing


def test_histograms_with_a_hot_request_and_a_hot_feature(spark):
    # Request 0 has a third of the slots; feature 9 is in every slot, owned and shared.
    rng = random.Random(5)
    requests = {0: 400, **{r: 2 for r in range(1, 401)}}
    rows, texts = [], []
    for req, slots in requests.items():
        common = [9, rng.randint(10, 14)]
        segs = [(rng.randint(0, 5), [9, rng.randint(10, 40)]) for _ in range(slots)]
        rows += [(req, i, show, 0, own, common) for i, (show, own) in enumerate(segs, 1)]
        texts.append(
            "\t".join(
                ["0 0 " + " ".join(map(str, common))]
                + [f"{show} 0 " + " ".join(map(str, own)) for show, own in segs]
            )
        )
    schema = "req LONG, seg INT, show INT, click INT, feats ARRAY<LONG>, common ARRAY<LONG>"
    imps = spark.createDataFrame(rows, schema)
    plain, replacing = replay(texts)
    assert as_dict(feature_histogram(imps)) == plain
    assert as_dict(last_write_histogram(imps)) == replacing


def test_replacing_histogram_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("clicktide.operators.histogram.BROADCAST_MAX_PAIRS", 1)
    rng = random.Random(6)
    texts = [random_line(rng) for _ in range(200)]
    imps = explode_slots(parse_requests(lines(spark, texts)))
    assert as_dict(last_write_histogram(imps)) == replay(texts)[1]
