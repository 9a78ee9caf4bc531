import __spark_entry__ as contract
import corpus_pipeline
from clicktide.llm import queries
from clicktide.llm.storage import numbered, stored
from test_llm_packing import check
from test_llm_quality import expected
from test_llm_simhash import brute
from test_llm_substrings import brute as repeated


def test_every_query_is_registered():
    names = contract.queries().keys()
    assert queries.queries().keys() | {"pipeline"} <= names
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert queries.oracle_sql().keys() <= queries.queries().keys()


def test_stages_work_on_what_the_one_before_kept(spark, small, given):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small))
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "quality rules":
            kept = {i for i, t in given if i in {r.doc_id for r in rows}}
            for i, text in given:
                n_words, _, _, _, n_repeat, *_ = expected(text)
                if n_words < 20 or 100 * n_repeat > 30 * n_words:
                    assert i not in kept
            assert len(kept) > len(given) / 2
        elif name == "SimHash near-dedup":
            classes = brute([(r.doc_id, r.text) for r in before.values()])
            assert sorted(r.doc_id for r in rows) == sorted({c for _, _, c in classes})
        elif name == "substring dedup":
            want = {i: n - gone for i, n, gone, _ in repeated([(r.doc_id, r.text) for r in before.values()])}
            assert {r.doc_id: len(r.text.encode().split()) for r in rows} == {i: n for i, n in want.items() if n}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "mixing sources":
            assert {r.doc_id for r in rows} <= before.keys()
            assert all(r.text == before[r.doc_id].text for r in rows)
        else:
            check(rows, texts)
        texts = [(r.doc_id, r.text) for r in rows] if name != "packing" else []
        before = {r.doc_id: r for r in rows}


def test_run_gives_the_last_stage(spark, small):
    assert "sequence_id" in corpus_pipeline.run(spark, small).columns


def test_odd_documents_pass_all_stages(spark, make_docs, odd_texts, tmp_path):
    docs = make_docs(odd_texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_numbers_are_dense(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") % 7).alias("k"))
    assert sorted(r.n for r in numbered(df, [F.col("k")], "n").collect()) == list(range(1000))


def test_stages_leave_nothing_but_what_the_result_reads(spark, small):
    from clicktide.session import ensure_checkpoint_dir, names_in

    place = ensure_checkpoint_dir(spark)
    before = set(names_in(spark, place))
    packed = corpus_pipeline.run(spark, small)
    left = {n for n in names_in(spark, place) if n not in before and n.startswith(("stored-", "table-"))}
    read = {p.split("/")[-2] for p in packed.inputFiles()}
    assert packed.count() > 0 and read <= left and len(left) <= len(read) + 1


def test_workers_give_memory_back_when_a_task_ends():
    import os
    import numpy as np
    from clicktide.llm.text import released

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    before = held()

    def run(batches):
        # Small blocks on the heap, freed but for the last one, which keeps the heap from shrinking.
        blocks = [np.ones(8000) for _ in range(3000)]
        yield len(blocks)
        last = blocks[-1:]
        del blocks
        yield last

    *_, last = released(run)(iter([]))
    assert held() - before < 100_000_000 and last
