import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tidegrid.llm.token_counts import TokenRollup, count_tokens

CHANGES = "doc_id long, source string, lang string, tokenizer_version string, op string, n_tokens long, old_n_tokens long, n_docs int"


def batch(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], CHANGES)


def totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=str)


def test_deltas_replays_and_conflicts(spark):
    rollup = TokenRollup(spark)
    assert totals(rollup) == []
    load = batch(spark, (1, "a", "en", "v1", "insert", 10, None), (2, "a", "en", "v1", "insert", 5, None),
                 (3, None, None, None, "insert", None, None), (2, "a", "en", "v1", "insert", 5, None))
    assert rollup.commit("load", load) and not rollup.commit("load", load.repartition(3))
    assert totals(rollup) == [("a", "en", "v1", 3, 20), (None, None, None, 1, 0)]
    change = batch(spark, (1, "a", "en", "v1", "revise", 12, 10), (2, "a", "en", "v1", "delete", 5, None),
                   (3, None, None, None, "delete", 0, None))
    assert rollup.commit("../odd name", change)
    assert totals(rollup) == [("a", "en", "v1", 2, 17)]
    with pytest.raises(ValueError):
        rollup.commit("load", change)
    # A delta without its log row is not counted and is overwritten by the next attempt.
    rollup._append_log = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        rollup.commit("late", load)
    again = TokenRollup(spark, rollup.folder)
    assert totals(again) == [("a", "en", "v1", 2, 17)]
    assert again.commit("late", load.limit(0)) and totals(again) == [("a", "en", "v1", 2, 17)]
    with pytest.raises(Exception):
        again.commit("bad", batch(spark, (1, "a", "en", "v1", "upsert", 1, None)))


def test_counts(edge_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = count_tokens(edge_docs, path)
    assert rows.count() == edge_docs.count()
    assert rows.filter("n_bytes = 0").agg(F.sum("n_tokens")).first()[0] == 0
    assert count_tokens(no_docs, path).count() == 0


def test_query_counts_every_row(spark, edge_docs, tmp_path, monkeypatch):
    from tidegrid.llm.queries import op9_token_counts

    more = spark.createDataFrame(
        [(100 + i, x, "void", "en") for i, x in enumerate([None, "", ""])], "doc_id long, text string, source string, lang string")
    docs = edge_docs.select(*more.columns).unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    committed = {}
    commit = TokenRollup.commit

    def told(self, batch, changes):
        committed[batch] = {r.op: r["count"] for r in changes.groupBy("op").count().collect()}
        return commit(self, batch, changes)

    monkeypatch.setattr(TokenRollup, "commit", told)
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in op9_token_counts(spark, str(tmp_path)).collect()}
    counts = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).groupBy("source", "lang").agg(F.sum("n_tokens").alias("n"))
    tokens = {(r.source, r.lang): r.n for r in counts.collect()}
    want = {(r.source, r.lang): (r["count"], tokens[r.source, r.lang]) for r in docs.groupBy("source", "lang").count().collect()}
    assert got == want and got["void", "en"] == (3, 0)
    deleted = sum(c.get("delete", 0) for c in committed.values())
    assert 0 < deleted < docs.count()  # deletion takes rows away here
