import random
import re

import numpy as np
import pytest
import xxhash

from clicktide.llm import simhash
from clicktide.llm.components import components


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(names, linked):
    parent = list(range(len(names)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    least = {}
    for i, name in enumerate(names):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [least.get(find(i)) for i in range(len(names))]


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    comps = least_reachable([i for i, _ in rows], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    return sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps)), key=repr)


def test_given_documents(spark, small, given):
    got = simhash.op2_simhash(spark, small).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(given)


def test_odd_rows(spark, make_docs, odd_texts):
    rows = [r for r in odd_texts if r[0] != 8]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    named = [(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in got]
    assert sorted(named, key=repr) == brute(rows)
    assert simhash.near_duplicates(make_docs(odd_texts).limit(0)).count() == 0


def test_very_long_text():
    text = " ".join(str(i) for i in range(70_000))
    assert simhash.simhash(text.encode()) % 2**64 == fingerprint(text)


@pytest.mark.parametrize("pair_rows", [2, 64])
@pytest.mark.parametrize("n_near", [0, 200])
def test_links_join_the_same_fingerprints(spark, pair_rows, n_near):
    rng = random.Random(n_near)
    fps = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    for _ in range(n_near):
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in components(simhash.links(df, pair_rows=pair_rows)).collect()}
    near = lambda a, b: ((fps[a] ^ fps[b]) % 2**64).bit_count() <= 2
    expected = least_reachable(fps, near)
    assert [got.get(f, f) for f in fps] == expected


@pytest.mark.parametrize("distance", [0, 1, 3, 4])
def test_links_at_other_distances(spark, distance):
    """Sparse values, and a crowd that shares keys: pairs and neighbours against brute force."""
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(30)}
    fps = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    near = lambda a, b: ((fps[a] ^ fps[b]) % 2**64).bit_count() <= distance
    expected = least_reachable(fps, near)
    for pair_rows in (4, 64):
        got = {r.node: r.component for r in components(simhash.links(df, distance, pair_rows)).collect()}
        assert [got.get(f, f) for f in fps] == expected


def test_distances_without_a_bounded_way_are_refused(spark):
    df = spark.createDataFrame([(1,)], "fp long")
    for distance in (-1, simhash.MOST_DISTANCE + 1):
        with pytest.raises(ValueError, match="distance"):
            simhash.links(df, distance)


def test_thresholds_add_up_and_follow_cost():
    rng = np.random.default_rng(0)
    bits = rng.random((2000, 64)) < 0.5
    bits[:, 40:] = rng.random((2000, 24)) < 0.01
    both = bits.T.astype(float) @ bits
    for m in simhash.PARTS:
        parts = simhash.correlated_parts(2000, both, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        _, chosen = simhash.allocate(2000, both, parts)
        assert sum(t + 1 for t in chosen) == simhash.DISTANCE + 1


def test_one_of_each_keeps_one_row_per_class(spark, make_docs, odd_texts):
    rows = [r for r in odd_texts if r[0] != 8]
    got = simhash.one_of_each(make_docs(rows)).collect()
    fps = [fingerprint(t) for _, t in rows]
    classes = set(least_reachable(list(range(len(rows))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2))
    assert len(got) == len(classes)
    assert len({(r.doc_id, r.text) for r in got}) == len(got)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 230)] + [(5, 5), (None, 3), (300, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[i] == 7 for i in [7, 300, *range(200, 230)]) and got[5] == 5 and 3 not in got
    assert components(df.limit(0)).count() == 0
