import corpus_pipeline
from tests.llm.test_exact_dedup import lower
from tests.llm.test_near_dedup import brute
from tests.llm.test_secret_scan import brute as spans_of

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.columns == columns
        after = docs.collect()
        if name == "language_id":
            wanted = {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
            assert {r.doc_id for r in after} == wanted
        elif name == "exact_dedup":
            wanted = {lower(r.text): r.doc_id for r in sorted(before, key=lambda r: r.doc_id)}
            assert {r.doc_id for r in after} == set(wanted.values())
        elif name == "near_dedup":
            classes = brute([(r.doc_id, r.text) for r in before])
            wanted = {}
            for r, c in zip(before, classes, strict=True):
                wanted[c] = max(wanted.get(c, -1), r.doc_id)
            assert {r.doc_id for r in after} == set(wanted.values())
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            texts = {r.doc_id: r.text for r in after}
            assert all((texts[r.doc_id] == r.text) == (spans_of(r.text)[0] == "") for r in before)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before}


def test_run_has_the_same_rows(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_edges(spark, edges, no_documents):
    for start in (edges, no_documents):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
        docs.collect()
