import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import differences, duck
from clicktide.llm import search as se
from clicktide.llm.queries import oracle_sql
from clicktide.llm.text import NOT_ALNUM, slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """[(item_id, rank, doc_id, score)] straight from the definition."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n_docs) // max(n_terms, 1)
            score = 0
            for t in terms(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r[0], r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "x_y", "A1", "0"]
    rank = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, rank, k=rng.choice([1, 3, 20, 60, 200])))) for i in range(300)]


@pytest.fixture(scope="module")
def items(corpus):
    rng = random.Random(6)
    some = [(i, " ".join(rng.sample(rng.choice(corpus)[1].split(), 1) * rng.randint(1, 3) + ["w3", "w40, W41!"])) for i in range(25)]
    return some + [(7, "w5 w5 w6"), (7, "w5 w5 w6"), (None, "w9"), (100, None), (101, "?!"), (102, "unknown")]


def table(spark, pairs, names):
    df = spark.createDataFrame(pairs, f"{names[0]} long, text string")
    for extra in ("segment", "term", "score", "rank", "_item", "doc_id" if names[0] != "doc_id" else "item_id"):
        df = df.withColumn(extra, F.lit("clash"))
    return df


@pytest.mark.parametrize("block_pairs", [5, 10**6])
def test_against_brute_force(spark, corpus, items, odd_texts, block_pairs):
    docs = corpus + odd_texts
    index = se.build(table(spark, docs, ["doc_id"]).repartition(7))
    found = se.search(index, table(spark, items, ["item_id"]), block_pairs=block_pairs)
    expected = brute(docs, items)
    assert rows(found) == expected and len(expected) > 300
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert index.rows.filter("term = ''").agg(F.sum(F.size("ids"))).first()[0] == len(docs)


def test_empty_tables(spark, corpus, items):
    none = spark.createDataFrame([], "doc_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string")
    queries = table(spark, items, ["item_id"])
    for docs in (none, blank):
        assert se.search(se.build(docs), queries).count() == 0
    assert se.search(se.build(table(spark, corpus[:5], ["doc_id"])), queries.limit(0)).count() == 0


def _segment(texts, ids):
    (part,) = slices(pa.array(texts), NOT_ALNUM, True)
    segment = se._Segment()
    segment.add(part)
    n_docs = sum(1 for t in texts if terms(t))
    n_terms = sum(len(terms(t)) for t in texts)
    batches = list(se._segment_rows(segment, pa.array(ids, pa.int64()), 3, n_docs, n_terms))
    return pa.Table.from_batches(batches)


def test_postings_are_ordered_by_stratum_and_tf(corpus):
    table = _segment([t for _, t in corpus], [i for i, _ in corpus])
    head, *rest = table.to_pylist()
    assert head["term"] == "" and sorted(head["ids"]) == [i for i, _ in corpus]
    m = memoryview(head["tfs"]).cast("q").tolist()
    assert m == sorted(m)
    bags = {i: Counter(terms(t)) for i, t in corpus}
    for row in rest:
        docs, tfs = memoryview(row["docs"]).cast("H").tolist(), memoryview(row["tfs"]).cast("i").tolist()
        assert {(head["ids"][d], tf) for d, tf in zip(docs, tfs)} == {
            (i, b[row["term"]]) for i, b in bags.items() if b[row["term"]]
        }
        assert (keys := [(m[d], tf, d) for d, tf in zip(docs, tfs)]) == sorted(keys)


def test_visits_stop_early_and_lose_nothing(corpus, items, monkeypatch):
    """The k best of a segment are those of an exhaustive scan, though strata are left out."""
    monkeypatch.setattr(se, "FIRST_VISIT", 4)
    table = _segment([t for _, t in corpus], [i for i, _ in corpus])
    names = sorted({t for _, text in items for t in terms(text)})
    opened = se._Opened(table, {t: i for i, t in enumerate(names)})
    visited = []
    ranges = se._ranges
    monkeypatch.setattr(se, "_ranges", lambda a, n: visited.append(int(n.sum())) or ranges(a, n))
    most = 0
    for _, text in items:
        bag = Counter(t for t in terms(text) if t in names)
        of = np.array([names.index(t) for t in bag], int)
        weights = np.array([7 * n for n in bag.values()], np.int64)
        got = se.best_of(opened, of, weights, 3)
        found = list(zip(got[0].tolist(), got[1].tolist()))
        whole = se.best_of(opened, of, weights, len(corpus))
        full = sorted(zip((-whole[1]).tolist(), opened.ids.take(pa.array(whole[0])).to_pylist(), whole[0].tolist()))
        assert found == [(d, -s) for s, _, d in full[:3]]
        most += sum(opened.size[a:b].sum() for t in of.tolist() if t in opened.runs for a, b in [opened.runs[t]])
    # Half of the visits are those of the exhaustive scans.
    assert sum(visited) < 1.95 * most


def test_query_equals_sql(spark, small):
    assert differences(spark, small, duck(small), se.op11_search, oracle_sql()["op11_search"]) is None
