import duckdb
import pytest

from checks.compare import differences, duck
from clicktide.llm import mixing


def test_equals_sql(spark, small):
    assert differences(spark, small, duck(small), mixing.op9_mix, mixing.OP9_SQL) is None


def test_targets_stop_at_the_limit(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 10), ("d", 0), (None, 500)]
    rows = spark.createDataFrame(sizes, "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    # Weights 5, 2, 1, 5, 2 for a, b, c, d, null; b, c and d are at three times their size.
    assert got["b"] == 30 and got["c"] == 30 and got["d"] == 0
    rest = 1520 - 60
    assert got["a"] == pytest.approx(rest * 5 / 7) and got[None] == pytest.approx(rest * 2 / 7)
    assert sum(got.values()) == pytest.approx(1520)


def test_copies_follow_targets_and_agree(spark, make_docs):
    rows = [(i, "w " * (1 + i % 50), "big" if i % 3 else "small") for i in range(600)]
    docs = make_docs(rows)
    first = mixing.mix(docs).select("doc_id", "size", "source", "target", "source_size", "copies", "taken").collect()
    again = mixing.mix(docs.repartition(7)).select("doc_id", "copies").collect()
    assert {(r.doc_id, r.copies) for r in first} == {(r.doc_id, r.copies) for r in again}
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in first)
    for source in ("big", "small"):
        own = [r for r in first if r.source == source]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.02)
    assert mixing.mixed(docs).count() == sum(r.copies for r in first)
    assert mixing.mixed(docs).columns == docs.columns


def test_odd_rows(spark, make_docs, odd_texts):
    docs = make_docs([(*r, None if i % 4 == 0 else f"s{i % 3}") for i, r in enumerate(odd_texts)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd_texts)
    assert sum(r.size for r in rows if r.doc_id == 1) == 0
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    empty = make_docs([(1, None), (2, "")])
    assert [r.taken for r in mixing.mix(empty).collect()] == [0, 0]


def test_sql_runs_on_an_empty_table():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    assert con.execute(mixing.OP9_SQL).fetchall() == []


def test_clashing_columns(spark):
    rows = [(i, "w " * (i % 9), "s", i + 1000, "t", "c") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, Target string, copies string")
    assert {(r.doc_id, r.size, r.Target, r.copies) for r in mixing.mixed(docs).collect()} <= {(r[0], r[3], "t", "c") for r in rows}
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    assert {(r.doc_id, r.size) for r in mixed.collect()} == {(i, i % 9) for i in range(50)}
