"""Lines by file and offset: the same for every split, whatever the files hold."""

import gzip
import io
import random

import pytest

from clicktide.sources import bytelines as bl
from clicktide.sources.impressions import read_impressions, read_lines, read_lines_by_offset

NASTY = [
    b"", b"\n", b"one", b"one\ntwo\n", b"\n\n\na\n\n", "é\nüß\n€uro".encode(), b"x" * 5000 + b"\nshort\n" + b"y" * 300,
    b"a\r\nb\r\n\r\nc", b"bad \xff byte\nnext\n",
]


def expected(data):
    """[(offset, text)] of all lines."""
    out, at = [], 0
    for line in io.BytesIO(data):
        out.append((at, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line)
    return out


@pytest.mark.parametrize("data", NASTY)
@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_ranges_partition_the_lines(data, size, monkeypatch):
    for chunk in (1, 5, 1 << 20):
        monkeypatch.setattr(bl, "CHUNK_BYTES", chunk)
        if chunk == 1 and len(data) > 1000:
            continue
        got = []
        for start in range(0, len(data), size):
            part = bl.Range(3, "x", start, min(len(data), start + size), False)
            for batch in bl.lines_of(io.BytesIO(data), part):
                assert set(batch.column(0).to_pylist()) == {3}
                got += zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        assert got == expected(data)


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    rng = random.Random(2)
    path = tmp_path_factory.mktemp("lines")
    (path / "sub").mkdir()
    for name in ("b", "a", "sub/c", "_SUCCESS", ".hidden"):
        lines = [f"{rng.randint(1, 9)} 1 {rng.randint(10, 99)}:s" for _ in range(rng.randint(50, 400))]
        (path / name).write_text("\n".join(lines) + ("\n" if name == "b" else ""))
    (path / "d.gz").write_bytes(gzip.compress(b"1 0 5:x\n2 1 7:y"))
    (path / "e").write_text("")
    return path


def test_numbers_do_not_depend_on_splits(spark, log):
    got = {n: sorted(read_lines_by_offset(spark, str(log), n).collect()) for n in (17, 1000, 1 << 27)}
    assert got[17] == got[1000] == got[1 << 27]
    assert read_lines_by_offset(spark, str(log), 17).rdd.getNumPartitions() > 100
    assert read_lines_by_offset(spark, str(log)).rdd.getNumPartitions() == 1
    rows = got[17]
    assert len({r.req for r in rows}) == len(rows)
    names = sorted(p for p in map(str, log.rglob("*")) if p.rsplit("/", 1)[1] in ("a", "b", "c", "d.gz", "e"))
    for r in rows:
        raw = open(names[r.req >> 40], "rb").read()
        if names[r.req >> 40].endswith("gz"):
            raw = gzip.decompress(raw)
        assert raw[r.req & (1 << 40) - 1 :].split(b"\n")[0].decode() == r.value
    # Spark's own text scan sees the same lines, but for hidden ones.
    theirs = [r.value for p in names for r in read_lines(spark, p).collect()]
    assert sorted(r.value for r in rows) == sorted(theirs)


def test_impressions_by_offset(spark, log):
    a, b = (read_impressions(spark, f"file://{log}", by_offset=True, split_bytes=n) for n in (40, 4000))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count() > 150


def test_empty_and_missing_paths(spark, tmp_path):
    assert read_lines_by_offset(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        read_lines_by_offset(spark, str(tmp_path / "nowhere")).count()
    with pytest.raises(Exception, match="positive"):
        read_lines_by_offset(spark, str(tmp_path), 0).count()


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_small_ranges_read_little_of_a_large_file():
    data = b"some line of a log\n" * 50_000
    stream = Counted(data)
    got = []
    for start in range(0, len(data), 60_001):
        part = bl.Range(0, "x", start, min(len(data), start + 60_001), False)
        got += [o for b in bl.lines_of(stream, part) for o in b.column(1).to_pylist()]
    assert got == [at for at, _ in expected(data)]
    assert stream.taken < 2 * len(data)


def test_small_ranges_of_large_files_share_tasks():
    class Info:
        path, size = "x", 10_000_000_000

    parts = bl.split([Info], 60_001)
    ranges = [r for p in parts for r in p.ranges]
    assert len(parts) <= 2 * bl.TASKS and all(r.end - r.start <= 60_001 for r in ranges)
    assert [r.start for r in ranges] == [0] + [r.end for r in ranges[:-1]] and ranges[-1].end == Info.size
    # Ranges as large as the default keep a task each.
    Info.size = 10 << 40
    assert len(bl.split([Info], bl.SPLIT_BYTES)) == (10 << 40) // bl.SPLIT_BYTES


def test_tasks_of_several_ranges_read_all_lines(spark, log, monkeypatch):
    whole = sorted(read_lines_by_offset(spark, str(log)).collect())
    monkeypatch.setattr(bl, "TASKS", 3)
    files = bl.listed(str(log))
    reader = bl.ByteLinesReader(str(log), 17)
    parts = reader.partitions()
    assert len(parts) <= 7 and len({r.path for p in parts for r in p.ranges}) == sum(f.size > 0 for f in files)
    rows = [r for p in parts for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted((f << 40 | o, v) for f, o, v in rows) == [(r.req, r.value) for r in whole]
