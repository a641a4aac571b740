import random

import pytest

from tests.llm import plain
from tidegrid.llm.line_dedup import line_dedup


@pytest.mark.parametrize("batches, fan_in", [(1, 2), (5, 2), (4, 3)])
def test_against_brute_force(spark, batches, fan_in):
    rnd = random.Random(1)
    lines = [f"Line number {k} of the common ones" for k in range(12)] + ["short", "", "  ÄÖ padded é line of some size \t", "x" * 20]
    docs = [(k, "\n".join(rnd.choice(lines).swapcase() if rnd.random() < 0.3 else rnd.choice(lines)
                          for _ in range(rnd.randint(0, 6)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    rows = line_dedup(df, batches=batches, fan_in=fan_in).collect()
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in rows}
    assert got == plain.line_dedup(docs)


def test_edges(edge_docs, no_docs):
    rows = line_dedup(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    line = "The same line in several documents, long enough to count."
    holders = {r["doc_id"] for r in rows if line.lower() in r["text"].lower()}
    assert holders == {12}
    assert next(r for r in rows if r["doc_id"] == 12)["text"] == line + "\n" + line  # all or none of a document
    assert all(r[-2] >= 1 for r in rows) and rows[0].__fields__[:-2] == edge_docs.columns
    assert line_dedup(no_docs).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    line = "a line that is long enough to be looked at"
    rows = [(1, line), (1, line), (1, line), (2, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["n_dropped"] == 0 for r in line_dedup(df).collect())
    df = spark.createDataFrame([*rows, (None, line)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup(df).collect()} == {1: 1, 2: 0, None: 1}
