import math

import numpy as np
import pytest

from clicktide.llm import embeddings


def brute(rows):
    unit = []
    for _, v, label in rows:
        good = v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.float32(v).astype(float) if good else None
        unit.append(x / np.linalg.norm(x) if good else None)
    n, parent = len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            same = unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
            if same and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = [(r[0], links[i], least.get(find(i))) for i, r in enumerate(rows)]
    return sorted(((i, k, c, i is not None and i == c) for i, k, c in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out, vec_id = [], 0
    for label in (1, 2, None):
        for _ in range(40):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 5)):
                out.append((vec_id, [float(x) for x in np.float32(centre + rng.normal(size=16) * 0.15)], label))
                vec_id += 1
    crowd = rng.normal(size=16)
    out += [(vec_id + i, [float(x) for x in np.float32(crowd + rng.normal(size=16) * 0.05)], 1) for i in range(60)]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("cell_rows, block_rows", [(4096, 256), (20, 256), (20, 8)])
def test_links_are_those_of_brute_force(spark, rows, cell_rows, block_rows, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block_rows)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_vectors(spark):
    a, b = [1.0, 0.0], [0.99, 0.05]
    odd = [
        (1, a, 1), (1, a, 1), (2, a, 1), (3, b, 1), (4, a, 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [0.0, -0.0], 1),
        (8, [None, 1.0], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1), (11, a, None), (12, [], 1),
        (13, [1.0, 0.0, 0.0], 1), (14, [1e-30, 0.0], 1), (15, [3e38, 0.0], 1), (None, a, 3), (None, b, 3), (16, [2.0, 0.0], 2),
    ]
    df = spark.createDataFrame(odd, SCHEMA)
    assert got(df) == brute(odd)
    assert got(df.limit(0)) == []


def test_query(spark, small):
    data = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    expected = brute([(r.vec_id, r.embedding, r.label) for r in data])
    assert sorted((tuple(r) for r in embeddings.op1_embeddings(spark, small).collect()), key=repr) == expected


def test_many_centres_of_long_vectors_take_little_memory(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(1024, 768)))
    x = np.concatenate([centres[rng.integers(0, 1024, 2900)] + rng.normal(0, 0.002, (2900, 768)), rng.normal(size=(20, 768))])
    held = {}

    class Rows:
        columns = ["uid", "embedding"]
        schema = []

        def mapInArrow(self, function, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x))], self.columns)
            tracemalloc.start()
            held["out"] = [[c.to_numpy(zero_copy_only=False) for c in (b.column(0), b.column(2), b.column(3))] for b in function(iter([batch]))]
            held["peak"] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()

    embeddings.assigned(Rows(), centres, 0.93)
    assert held["peak"] < 200e6
    # Each vector is in its home and in each cell that may hold a partner of it.
    uid, cell, home = (np.concatenate(c) for c in zip(*held["out"]))
    got = set(zip(uid.tolist(), cell.tolist()))
    near = unit(x) @ centres.T
    width = np.linalg.norm(centres[near.argmax(axis=1)][:, None][:20] - centres[None], axis=2)
    gap = near.max(axis=1, keepdims=True) - near
    wanted = set(zip(*(v.tolist() for v in np.nonzero(gap[:20] <= np.sqrt(1 - 0.93**2) * width))))
    assert wanted <= got and {(i, int(c)) for i, c in enumerate(near.argmax(axis=1))} <= got
    assert home.sum() == len(x)
