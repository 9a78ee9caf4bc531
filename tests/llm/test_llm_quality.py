import re
from collections import Counter

from checks.compare import differences, duck
from clicktide.llm import quality


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(repeated), len(lines), sum(a == b for a, b in zip(words, words[1:])),
    )


def test_equals_sql(spark, small):
    assert differences(spark, small, duck(small), quality.op3_quality, quality.OP3_SQL) is None


def test_measures_of_odd_rows(spark, make_docs, odd_texts):
    rows = quality.ledger(make_docs(odd_texts)).collect()
    got = Counter((r.doc_id, *(r[m] for m in quality.MEASURES)) for r in rows)
    assert got == Counter((i, *expected(t)) for i, t in odd_texts)
    assert all(r.fail_bits & 1 for r in rows if r.n_words < 20)
    assert quality.ledger(make_docs(odd_texts).limit(0)).count() == 0


def test_ablations_count_what_a_rule_alone_rejects(spark, make_docs):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(1, clean), (2, "few"), (3, "few words"), (4, clean + " ###" * 20), (5, "# " * 10)]
    ledger = quality.ledger(make_docs(rows))
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(ledger, "v1").collect()}
    assert got["few_words"] == (3, 2)
    assert got["symbols"] == (2, 0)
    assert got["repeated_windows"] == (2, 0)
    kept = {r.doc_id for r in ledger.filter(quality.kept("v1")).collect()}
    assert kept == {1}


def test_what_the_method_adds(spark, make_docs):
    words = [f"word{i}" for i in range(40)]
    prose = "\n".join(" ".join(words[i : i + 10]) for i in range(0, 40, 10))
    rows = [
        (1, prose), (2, f"a b c d e\n{prose}\na b c d e"), (3, "x y z\n" * 2 + prose),
        (4, " ".join(w for w in words[:12] for _ in range(4))), (5, "\n".join(w for w in words for _ in range(2))),
    ]
    kept = {r.doc_id for r in quality.ledger(make_docs(rows)).filter(quality.kept()).collect()}
    assert kept == {1, 2, 3}


def test_policies_read_bits_only(spark):
    rows = spark.createDataFrame([(quality.BIT["symbols"],), (0,)], "fail_bits long")
    assert [r[0] for r in rows.select(quality.kept("base")).collect()] == [True, True]
    assert [r[0] for r in rows.select(quality.kept("v1")).collect()] == [False, True]
