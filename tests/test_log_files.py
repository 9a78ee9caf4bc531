"""Logs written by queries: no task writes a large one whole."""

from checks import queries


def test_a_large_log_has_several_files(spark, small, monkeypatch, tmp_path):
    place = tmp_path / "log"
    whole = sorted(queries.q_imp_parse_partitions(spark, small).drop("n_tasks").collect())
    monkeypatch.setattr(queries, "FILE_ORDERS", 300)
    monkeypatch.setattr(queries, "_new_place", lambda spark: str(place))
    rows = queries.q_imp_parse_partitions(spark, small)
    assert sorted(rows.drop("n_tasks").collect()) == whole
    sizes = [p.stat().st_size for p in place.glob("part-*")]
    assert len(sizes) == 6 and max(sizes) < sum(sizes) / 2
