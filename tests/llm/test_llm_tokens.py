import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktide.llm import tokens


def fresh(text):
    count = tokens.counter()
    pieces = count.pattern.findall(text)
    return pieces, count.counts(pieces)


@pytest.mark.parametrize("seed", range(60))
def test_edits_end_where_a_fresh_count_does(seed):
    rng = random.Random(seed)
    alphabet = "ab c  \n\n\t.,!12'stre 🙂é"
    text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 40, 400, 4000])))
    pieces, counts = fresh(text)
    tree = tokens.TokenTree(text, list(map(len, pieces)), counts)
    for _ in range(10):
        start, removed = rng.randint(0, len(text)), rng.choice([0, 1, 3, 20, 300])
        inserted = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 30])))
        text = text[:start] + inserted + text[start + removed :]
        tree.edit(tokens.counter(), start, removed, inserted)
        pieces, counts = fresh(text)
        assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, len(text), sum(counts))
        assert [x.tolist() for x in tree.pretokens()] == [list(map(len, pieces)), counts]
        size = len(tree.sums) // 2
        for i in range(1, size):
            assert (tree.sums[i] == tree.sums[2 * i] + tree.sums[2 * i + 1]).all()
        # A tree stored now and opened again counts on from here.
        if rng.random() < 0.3:
            tree = tokens.TokenTree(tree.text(), *tree.pretokens(), tree.sums.ravel())


def test_an_edit_encodes_its_surroundings_only():
    text = "some words here " * 5000
    pieces, counts = fresh(text)
    tree = tokens.TokenTree(text, list(map(len, pieces)), counts)
    tree.edit(tokens.counter(), 40_000, 4, "other")
    assert tree.reencoded < 10


def test_an_edit_opens_few_leaves_of_a_stored_tree():
    text = "some words here " * 50_000
    pieces, counts = fresh(text)
    sums = tokens.leaf_sums(np.array(list(map(len, pieces))), np.array(counts))
    assert len(sums) > 2000 and sums[1].tolist() == [len(text), sum(counts), len(pieces)]
    tree = tokens.TokenTree(text, list(map(len, pieces)), counts, sums)
    for at in (400_000, 10, 799_990):
        tree.edit(tokens.counter(), at, 4, "other")
        text = text[:at] + "other" + text[at + 4 :]
    assert tree.opened <= 9 and tree.reencoded < 30
    assert tree.text() == text and tree.n_tokens == sum(fresh(text)[1])


def test_grown_leaves_are_dealt_anew():
    text, count = "a b c " * 100, tokens.counter()
    pieces, counts = fresh(text)
    tree = tokens.TokenTree(text, list(map(len, pieces)), counts)
    for _ in range(3):
        tree.edit(count, 300, 0, " more words" * 400)
        text = text[:300] + " more words" * 400 + text[300:]
    leaves = tree.sums[len(tree.sums) // 2 :, 2]
    assert leaves.max() <= 8 * tokens.LEAF and leaves.sum() == len(fresh(text)[0])
    assert tree.text() == text and tree.n_tokens == sum(fresh(text)[1])


def test_given_documents(spark, small, given):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = tokens.apply_edits(tokens.build_trees(tokens.with_scrub_edits(docs))).collect()
    texts, encode = dict(given), tokens.counter()._encode
    for r in rows:
        assert r.n_tokens_before == len(encode(texts[r.doc_id]))
        assert r.n_tokens == len(encode(r.text)) == sum(r.tokens)
    assert sum(r.n_edits for r in rows) > 0
    assert tokens.op4_token_counts(spark, small).count() == len(texts)


def test_trees_can_be_stored_and_edited_again(spark, make_docs):
    trees = tokens.build_trees(make_docs([(1, "a b c"), (2, None), (3, "")]))
    edits = spark.createDataFrame([(1, 2, 1, "xyz"), (2, 0, 0, "new text")], "id long, start long, removed long, inserted string")
    grouped = edits.groupBy("id").agg(F.collect_list(F.struct("start", "removed", "inserted")).alias("edits"))
    edited = tokens.apply_edits(trees.join(grouped, F.col("doc_id") == F.col("id"), "left"))
    rows = edited.collect()
    assert {r.doc_id: r.text for r in rows} == {1: "a xyz c", 2: "new text", 3: ""}
    assert {r.doc_id: r.n_tokens for r in rows} == {i: sum(fresh(t)[1]) for i, t in [(1, "a xyz c"), (2, "new text"), (3, "")]}
    again = edited.select("doc_id", "text", *tokens.TREE, F.expr("array(struct(0L AS start, 1L AS removed, 'q r' AS inserted))").alias("edits"))
    expected = {1: "q r xyz c", 2: "q rew text", 3: "q r"}
    assert {r.doc_id: (r.text, r.n_tokens) for r in tokens.apply_edits(again).collect()} == {
        i: (t, sum(fresh(t)[1])) for i, t in expected.items()
    }


def test_odd_rows(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts)
    rows = tokens.apply_edits(tokens.build_trees(tokens.with_scrub_edits(docs))).collect()
    expected = sorted(((i, sum(fresh(t or "")[1])) for i, t in odd_texts), key=repr)
    assert sorted(((r.doc_id, r.n_tokens_before) for r in rows), key=repr) == expected
    empty = tokens.apply_edits(tokens.build_trees(tokens.with_scrub_edits(docs.limit(0))))
    assert empty.count() == 0


def test_what_is_scrubbed():
    text = "mail a.b@c.example.org or 10.0.0.1, key " + "0f" * 16 + " and +49 30 1234567."
    for start, removed, inserted in tokens.scrub_edits(text):
        text = text[:start] + inserted + text[start + removed :]
    assert text == "mail <email> or <address>, key <secret> and <number>."


def test_clashing_columns(make_docs):
    docs = make_docs([(1, "mail a.b@c.example.org"), (1, "mail a.b@c.example.org"), (2, None)])
    for name in ("edits", "Tokens", "lengths", "Sums", "n_tokens", "N_Edits", "n_reencoded", "n_tokens_before"):
        docs = docs.withColumn(name, F.lit("x"))
    out = tokens.apply_edits(tokens.build_trees(tokens.with_scrub_edits(docs)))
    assert len({c.lower() for c in out.columns}) == len(out.columns) and "size" in out.columns
    assert sorted((r.doc_id, r.n_tokens, r.n_edits, r.size) for r in out.collect()) == [
        (1, sum(fresh("mail <email>")[1]), 1, "x"), (1, sum(fresh("mail <email>")[1]), 1, "x"), (2, 0, 0, "x"),
    ]
