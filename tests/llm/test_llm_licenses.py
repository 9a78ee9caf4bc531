import re

from checks.compare import differences, duck
from clicktide.llm import licenses


def test_equals_sql(spark, small):
    assert differences(spark, small, duck(small), licenses.op10_licenses, licenses.OP10_SQL) is None


def by_id(spark, docs):
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


def test_base_counts_every_place(spark, make_docs):
    rows = [
        (1, "CC BY-NC, cc by nc cc-by-nc"), (2, "Under THE mit\nLicense."), (3, "Apache License, Version 2.0"),
        (4, "under the mït license"), (5, "cc by"), (6, "x " * 20_000 + "under the MIT license"),
    ]
    got = by_id(spark, make_docs(rows))
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 6, "cc-by-nc")
    assert (got[2].n_base, got[2].base_labels, got[2].n_words, got[2].score) == (1, "mit", 4, 1.0)
    assert (got[3].base_labels, got[3].labels) == ("apache-2", "apache-2")
    assert got[4].n_base == got[5].n_base == 0 and got[4].first_word is None and got[4].base_labels == ""
    assert (got[6].first_word, got[6].last_word, got[6].n_words) == (20_000, 20_000, 20_004)


def test_notices_with_changes_are_found(spark, make_docs):
    notice = next(w for w, label in licenses.NOTICES.items() if label == "bsd")
    words = notice.split()
    changed = " ".join(words[:7] + ["really"] + words[7:])
    rows = [(1, f"a b c {notice} d"), (2, f"a {changed}"), (3, " ".join(words[:5]))]
    rows += [(4, "This work is licensed under the GNU General Public License, version 3.")]
    got = by_id(spark, make_docs(rows))
    assert got[1].labels == got[2].labels == "bsd" and got[1].score == 1.0 and 0.6 <= got[2].score < 1
    assert got[3].labels == "" and 0 < got[3].score < 0.6
    assert got[4].labels == "gpl-3" and got[4].base_labels == ""


def test_odd_rows(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts)
    rows = licenses.scan(docs).collect()
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)))
    expected = sorted(((i, words(t)) for i, t in odd_texts), key=repr)
    assert sorted(((r.doc_id, r.n_words) for r in rows), key=repr) == expected
    assert licenses.scan(docs.limit(0)).count() == 0


def test_words_put_in_do_not_hide_a_notice(make_docs):
    """Spans go on behind a gap in the text or in the template; further apart they do not."""
    notice = next(w for w, label in licenses.NOTICES.items() if label == "isc").split()
    put_in = lambda n: " ".join([*notice[:8], *(f"x{i}" for i in range(n)), *notice[8:]])
    rows = [(n, f"a {put_in(n)} b") for n in (0, 6, licenses.BAND, licenses.BAND + 1)]
    rows.append((100, " ".join(notice[:8] + notice[12:])))
    got = by_id(None, make_docs(rows))
    assert got[0].labels == got[6].labels == got[licenses.BAND].labels == "isc" and got[6].score > 0.8
    assert got[licenses.BAND + 1].labels == "" and got[100].labels == "isc"


def test_whole_license_texts(make_docs):
    rows = []
    for i, (text, label) in enumerate(licenses.TEXTS.items()):
        words = text.split()
        assert len(words) > 25
        rows += [(10 * i, text.upper()), (10 * i + 1, " ".join(words[: len(words) // 4]))]
    rows.append((1000, " ".join(next(iter(licenses.TEXTS)).split() * 3)))
    got = by_id(None, make_docs(rows))
    for i, label in enumerate(licenses.TEXTS.values()):
        assert label in got[10 * i].labels.split(",") and got[10 * i].score == 1.0
    assert "mit" in got[1000].labels.split(",")


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "cc by nc", 5, "t", 3)], "doc_id long, text string, n_base int, template string, grams int")
    (row,) = licenses.scan(docs).collect()
    assert (row.doc_id, row.n_base, row.base_labels) == (1, 1, "cc-by-nc")
