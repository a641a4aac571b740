import random

from tests.llm import plain
from tidegrid.llm import decontaminate as module
from tidegrid.llm.decontaminate import best_distance, budget, mark_contaminated, masks_of, normal


def test_bit_parallel_distance():
    rnd = random.Random(4)
    for _ in range(300):
        p = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 120)))
        assert best_distance(masks_of(p), len(p), t, -1) == plain.edit_window(p, t)


def test_edited_passages_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_CHARS", 300)  # several blocks
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rnd.randint(5, 30)))) for k in range(12)] + [(None, None), (90, "short")]
    docs = []
    for k in range(60):
        x = list(normal(rnd.choice(items[:12])[1]))
        for _ in range(rnd.randint(0, 14)):
            at = rnd.randrange(len(x))
            x[at:at + rnd.randint(0, 1)] = rnd.choice(["", "z", "q"])
        docs.append((k, " ".join([word(), word(), "".join(x).upper(), word()]).replace(" ", " ,\n")))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = mark_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: sorted(h.item_id for h in r["hits"]) for r in got.collect()}
    want = {i: [k for k, t in items[:12] if plain.edit_window(normal(t), normal(x)) <= budget(len(normal(t)))]
            for i, x in docs}
    assert got == want and any(want.values()) and not all(want.values())


def test_edges(spark, edge_docs, no_docs):
    line = "the same line in several documents long enough to count"
    items = spark.createDataFrame([(None, line), (5, line), (6, "")], "item_id long, text string")
    rows = mark_contaminated(edge_docs, items).collect()
    hit = {r["doc_id"]: [h.item_id for h in r[-1]] for r in rows if r[-1]}
    assert set(hit) == {9, 10, 11, 12} and all(sorted(map(str, h)) == ["5", "None"] for h in hit.values())
    assert all(not r[-1] for r in mark_contaminated(edge_docs, items.limit(0)).collect())
    assert mark_contaminated(no_docs, items).count() == 0


def test_short_items_stand_whole_between_words(spark):
    items = spark.createDataFrame([(1, "What is 12 * 7?"), (2, "日本語です"), (3, "!?"), (4, "a")], "item_id long, text string")
    docs = ["so, what IS 12*7", "what is 12 * 75", "日本語です。", "日本語ですか", "a", "ab ba", "b A!", "", "x what is 12 7 what is 12 7"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: [h.item_id for h in r.hits] for r in mark_contaminated(df, items).collect()}
    assert got == {0: [1], 1: [], 2: [2], 3: [], 4: [4], 5: [], 6: [4], 7: [], 8: [1]}
