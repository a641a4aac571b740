import random

from tests.llm import plain
from tidegrid.llm.pii import KINDS, detect, estimate_reliability, report


def test_base_spans_against_brute_force(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab.@+-1234567890 (é)_%🙂") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "4111 1111 1111 1111 a@b.c_d@e.f 1.2.3.4.5.6.7.8", "1" * 20000, "a@" + "b." * 9000 + "c", "1 " * 9000,
              "000.255.0256.1 +1 (23) 555-6677", "+" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [tuple(x) for x in r.base] for r in detect(df).collect()}
    assert got == {i: plain.base_spans(t or "") for i, t in enumerate(texts)}


def test_added_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = detect(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = [(KINDS[x.kind], texts[r.doc_id][x.start:x.end]) for r in rows for x in r.added]
    assert {k for k, _ in found} <= {"secret", "number"} and found
    for r in rows:
        for x in r.added:
            assert not any(b.start < x.end and x.start < b.end for b in r.base)


def test_reliability_follows_agreement():
    # Labeler 0 agrees with labelers 1 and 2, labeler 3 says yes at random.
    belief = estimate_reliability({"111122": 50, "111022": 50, "000122": 200, "000022": 200})
    assert belief["111022"] > 0.9 and belief["000122"] < 0.1


def test_edges_and_plan(edge_docs, no_docs):
    rows = report(detect(edge_docs))
    assert rows.count() == edge_docs.count() and report(detect(no_docs)).count() == 0
    assert "Python" not in rows._jdf.queryExecution().toString()
