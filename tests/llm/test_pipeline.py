import corpus_pipeline as pipeline
from tests.llm import plain
from tidegrid.llm.common import materialize
from tidegrid.llm.decontaminate import budget, normal

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = read("documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        if name == "encoding":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "quality":
            labels = [(r.doc_id, r.quality) for r in read("labels").collect()]
            right = sum((i in after) == bool(q) for i, q in labels)
            assert right / len(labels) > 0.9 and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            assert after == {i: t for i, (t, _) in plain.line_dedup(list(before.items())).items()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_dedup":
            groups = plain.near_components(list(before.items()), pipeline.SHINGLE_WORDS)
            assert after == {i: before[i] for i, (n, c) in groups.items() if i == c or n == 0}
        else:
            items = [normal(r.text) for r in read("benchmark").collect()]
            clean = {i for i, t in before.items()
                     if not any(m in normal(t) for m in items)}
            assert set(after) <= clean
            for i in clean - set(after):
                assert min(plain.edit_window(m, normal(before[i])) - budget(len(m)) for m in items) <= 0
        before = after
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(before) and all(r.round_trip for r in rows)


def test_run_and_edges(spark, edge_docs, no_docs):
    assert pipeline.run(spark, SF).count() > 0
    for docs in (edge_docs, no_docs):
        n = docs.count()
        for _, stage in pipeline.STAGES:
            out = materialize(stage(spark, docs, SF))
            assert out.count() <= n
            docs, n = out, out.count()
