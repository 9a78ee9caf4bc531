import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from clicktide.llm import substrings


def brute(texts, length=35):
    docs = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in docs for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(texts, docs):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_given_documents(spark, small, given):
    assert as_rows(substrings.op6_substrings(spark, small)) == brute(given)


def test_odd_rows(spark, make_docs, odd_texts):
    rows = [r for r in odd_texts if r[0] != 8] + [(8, " ".join(str(i % 977) for i in range(30_000)))]
    docs = make_docs(rows)
    assert as_rows(substrings.digest(docs)) == brute(rows)
    assert substrings.digest(docs.limit(0)).count() == 0
    assert substrings.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [1, 512])
def test_common_passages_in_shards_and_crowds(spark, make_docs, crowd, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    rng = random.Random(crowd)
    word = lambda: rng.choice("abcdefghijklmnop")
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        own = [word() + str(rng.randint(0, 300)) for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(own))
        part = passage[rng.randint(0, 20) :] if i % 2 else []
        rows.append((i, " ".join(own[:at] + part + own[at:])))
    rows += [(200, "same " * 90), (201, " ".join(passage + passage)), (202, ("same " * 70 + "q r s ") * 2)]
    rows += [(203, "q " + "same " * 50), (204, "r s " + "same " * 36 + "t"), (205, "only " * 35)]
    keyed = substrings._keyed(make_docs(rows).select("doc_id", "text"))
    names = {(r._k1, r._k2): r.doc_id for r in keyed.collect()}
    got = {names[r._k1, r._k2]: r.spans for r in substrings.repeats(keyed, crowd=crowd).collect()}
    removed = {}
    for doc_id, text in rows:
        spans = got.get(doc_id, [])
        at, bits = (np.array([s[k] for s in spans], np.int64) for k in ("at", "bits"))
        removed[doc_id] = int(substrings.covered(len(text.split()), at, bits).sum())
    assert removed == {i: n for i, _, n, _ in brute(rows)}


@pytest.mark.parametrize("seed", range(40))
def test_automaton_finds_repeated_windows(seed):
    rng = random.Random(seed)
    length = rng.randint(12, 16)
    texts = [[rng.choice("ab" if seed % 2 else "abcdefgh") for _ in range(rng.randint(length, 36))] for _ in range(6)]
    texts.append(texts[0][: length + 2] + ["z"] * 8)
    times = [rng.choice([1, 1, 2]) for _ in texts]
    seen = Counter()
    for t, n in zip(texts, times):
        for i in range(len(t) - length + 1):
            seen[tuple(t[i : i + length])] += n
    expected = [
        sum(1 << i for i in range(len(t) - length + 1) if seen[tuple(t[i : i + length])] > 1) for t in texts
    ]
    assert substrings.repeated_windows([" ".join(t).encode() for t in texts], times, length) == expected


def test_texts_keep_their_lines(spark, make_docs):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"first line\n\nsecond {passage} third\nlast"), (2, passage), (3, None), (4, "a  b")]
    got = {r.doc_id: r.text for r in substrings.without_repeats(make_docs(rows)).collect()}
    assert got == {1: "first line\n\nsecond third\nlast", 2: "", 3: None, 4: "a  b"}
