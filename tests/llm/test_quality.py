import numpy as np
from pyspark.sql import functions as F

from tidegrid.llm.quality import FEATURES, fit, held_out, score_quality, text_features, train


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    rows = scored.join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    good = [r["score"] for r in rows if r.quality == 1]
    bad = [r["score"] for r in rows if r.quality == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for g in good] for b in bad])
    assert auc > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_pairs_find_an_interaction():
    rnd = np.random.default_rng(0)
    x = np.zeros((4000, len(FEATURES)))
    x[:, 0], x[:, 1] = rnd.random(4000), rnd.random(4000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_inputs_are_the_text_alone(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, None), (8, None, 1), (9, 1, 1), (9, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = train(edge_docs, labels)
    rows = score_quality(edge_docs, model).collect()
    assert rows[0].__fields__[:-2] == edge_docs.columns and all(r["score"] is None for r in rows)
    assert len(rows) == edge_docs.count()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r[-2]) == r[-2]
        assert r[-1] == int(r[-2] >= 0.3)
    assert score_quality(no_docs, model).count() == 0
    none = train(no_docs, labels.limit(0))
    assert {round(r[-2], 6) for r in score_quality(edge_docs, none).collect()} == {0.5}
    assert len(text_features("")) == len(FEATURES)
