import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from clicktide.llm import packing


def check(rows, texts):
    """Pieces cover each document once, sequences have no gap and are full but for a slack, or a power of two."""
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    expected = Counter()
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        expected[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    sequences, tokens = defaultdict(list), Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
        if r.start == 0 and r.length == r.doc_tokens:
            expected[r.doc_id, r.doc_tokens, r.ids_crc32] -= 1
    totals = Counter()
    for doc_id, text in texts:
        totals[doc_id] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    assert tokens == totals
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 4096 - packing.SLACK <= at <= 4096 or at & (at - 1) == 0 and at < 4096
    return expected


def test_given_documents(spark, small, given):
    rows = packing.op5_pack(spark, small).collect()
    left = check(rows, given)
    # Documents that were cut are the only ones whose checksum did not appear as a whole.
    cut = {r.doc_id for r in rows if r.length < r.doc_tokens}
    assert {d for (d, _, _), n in left.items() if n} == cut
    texts = dict(given)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for r in rows:
        if r.doc_id in cut:
            ids = np.array(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_odd_rows(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts)
    check(packing.pack(docs).collect(), odd_texts)
    assert packing.pack(docs.limit(0)).count() == 0


def test_awkward_lengths_need_no_padding(spark, make_docs):
    texts = [(i, "a " * 2999) for i in range(20)]
    check(packing.pack(make_docs(texts)).collect(), texts)


def test_words_encode_like_the_text():
    import pyarrow as pa

    from clicktide.llm.text import slices

    rng = random.Random(1)
    texts = ["", "It's I'LL don't. a,b c., x.. É. école, ÅNGSTRÖM å Å", "<|startoftext|> A <|STARTOFTEXT|>.",
             "x \x1c q\x85r", "ΟΔΟΣ. ΣΑΣ, İstanbul.", "a" * 500 + ". ,", "日本語。テスト, end.", ".,. ,a .b"]
    texts += ["".join(rng.choice("aB'.,  sdtl\n1é!<|́") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    tokenizer, encoder = Tokenizer.from_file(packing.tokenizer_path()), packing.encoder(packing.tokenizer_path())
    got = [ids for part in slices(pa.array(texts)) for ids in encoder.ids(*packing.separated(part))]
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_fill_is_the_best_sum(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(0, 8)))
    room = rng.randint(0, 90)
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    chosen = packing.fill(counts, room)
    assert all(n <= counts[k] for k, n in chosen)
    assert sum(k * n for k, n in chosen) == max(s for s in sums if s <= room)


def test_plan_handles_many_pieces_at_once():
    plan = packing.plan({3000: 10**9, 1096: 10**9 // 2, 17: 5})
    assert len(plan.runs) < 3000 and plan.sequences < 10**9


def test_windows_close_to_full_are_padded_and_not_cut():
    lengths = {1000: 4, 90: 1, 2050: 2, 2040: 2}
    plan = packing.plan(lengths)
    assert plan.total == plan.whole == lengths and plan.sequences == 3
    # Each window lacks six ids of being full; without slack, pieces are cut.
    assert any(first < 0 for _, _, first, _, _ in packing.plan(lengths, slack=0).runs)


def test_any_tokenizer_packs_as_it_encodes(spark, make_docs, tmp_path):
    """A cased tokenizer that keeps blanks, and the given one with a step taken away."""
    import json

    config = json.load(open(packing.tokenizer_path()))
    assert packing.encodes_by_word(config)
    cased = json.loads(json.dumps(config))
    cased["normalizer"]["normalizers"].pop()
    other = json.loads(json.dumps(config))
    other["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    texts = [(1, "H h. Hh, İ x.\n\n y"), (2, None), (3, "<|endoftext|> A."), (4, "The Cat's. " * 900)]
    for name, changed in (("cased", cased), ("other", other)):
        path = str(tmp_path / name)
        with open(path, "w") as out:
            json.dump(changed, out)
        assert not packing.encodes_by_word(changed)
        tokenizer = Tokenizer.from_file(path)
        rows = packing.pack(make_docs(texts), path).collect()
        for doc_id, text in texts:
            ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
            own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc_id)
            assert [(s, n, c) for s, n, c, _ in own] == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n, _, _ in own]
            assert sum(n for _, n, _, _ in own) == len(ids) and {t for *_, t in own} == {len(ids)}


def test_capacity_must_be_a_power_of_two(make_docs):
    with pytest.raises(ValueError):
        packing.pack(make_docs([(1, "a")]), capacity=1000)
