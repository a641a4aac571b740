import random

import numpy as np

from tests.llm import plain
from tidegrid.llm.near_dedup import near_dedup, near_duplicates, run_keys


def compare(spark, docs, width):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width).collect()}
    assert got == plain.near_components(docs, width)


def test_families_passages_chains_and_tiny_texts(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    passages = [[word() for _ in range(60)] for _ in range(2)]
    texts = []
    for _ in range(2):
        base = [word() for _ in range(150)]
        for _ in range(60):
            x = list(base)
            for _ in range(rnd.randint(1, 9)):
                x[rnd.randrange(len(x))] = word()
            texts.append(" ".join(x))
    for _ in range(150):
        x = [word() for _ in range(rnd.randint(20, 120))]
        k = rnd.randrange(len(x))
        x[k:k] = rnd.choice(passages)
        texts.append(" ".join(x))
    chain = [word() for _ in range(100)]
    for _ in range(8):  # neighbours are similar, the ends are not
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(" ".join(chain))
    for n in range(3, 14):
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join([*base, word()]), " ".join([word(), *base])]
    texts += 2 * ["a", "a b", "a b c", "", "  ", "a b c d", "A B\tc D", "a b c d a b c d", "a b c d e f g h"]
    rnd.shuffle(texts)
    compare(spark, list(enumerate(texts)), 4)


def test_tables(spark, small_docs):
    compare(spark, [(r.doc_id, r.text) for r in small_docs.collect()], 5)


def test_a_linked_pair_of_whole_sets_shares_a_key():
    rnd = random.Random(1)
    for _ in range(3000):
        n = rnd.randint(1, 60)
        union = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        own = [set(), set()]
        only = rnd.sample(range(len(union)), len(union) // 5)
        for k, v in enumerate(union):
            for side in ([rnd.randrange(2)] if k in only else [0, 1]):
                own[side].add(v)
        a, b = (np.array(sorted(s), np.uint64) for s in own)
        assert set(run_keys(a, len(a))) & set(run_keys(b, len(b)))


def test_edges(edge_docs, no_docs):
    rows = near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.component_id == r.doc_id and r.kept for r in rows if r.n_shingles == 0)
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    kept = near_dedup(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and ids.count(5) == 0
    assert near_duplicates(no_docs).count() == 0 and near_dedup(no_docs).count() == 0


def test_lists_of_several_blocks_and_sparse_families(spark, monkeypatch):
    """Families of which a part of the pairs is linked, in lists that are cut into bands and blocks."""
    from tidegrid.llm import near_dedup as module

    monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(module, "COLUMNS", 50)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    texts = []
    for n, most in ((200, 10), (60, 12)):
        base = [word() for _ in range(n)]
        for _ in range(120):
            x = list(base)
            for _ in range(rnd.randint(3, most)):
                x[rnd.randrange(len(x))] = word()
            texts.append(" ".join(x[:rnd.randint(int(0.9 * n), n)]))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(rnd.randint(0, 60))] + passage) for _ in range(100)]
    compare(spark, list(enumerate(texts)), 4)


def test_rows_that_leave_the_search_stay_below_the_members(spark):
    """A list of more than 512 members, about a third of whose pairs is linked, emits no pairs by the square."""
    from pyspark.sql import functions as F

    from tidegrid.llm import near_dedup as module

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(1000):
        x = list(base)
        for k in rnd.sample(range(len(x)), 7):
            x[k] = word()
        texts.append(" ".join(x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = module.sketched(docs, 4)
    nodes = module.materialize(rows.select(
        F.monotonically_increasing_id().alias("node"), "n_shingles", "sketch",
        F.col("doc_id").alias("rep_id"), F.col("text_hash").alias("rep_hash")))
    entries = module.list_entries(nodes)
    assert entries.groupBy("key").count().agg(F.max("count")).first()[0] > 512
    none = spark.createDataFrame([], "node long, component long")
    members = module.in_groups(module.mixed_members(entries, none, 80).join(
        nodes.select("node", "sketch"), "node").select(*module.GROUP, "second", "node", "component", "size", "sketch"))
    assert module.forest_pairs(members, 80).count() < members.count()
    unresolved = module.materialize(module.open_members(members, 80))
    links = module.exact_links(unresolved, module.texts_of(unresolved, docs, nodes), 4, 80)
    groups = unresolved.select(*module.GROUP).distinct().count()
    assert links.count() <= unresolved.count() - groups


def test_only_percentages_the_lists_are_made_for(no_docs):
    import pytest

    with pytest.raises(ValueError):
        near_duplicates(no_docs, percent=79)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5, "x", 9), (2, "a b c d e", 6, "y", 8), (None, None, 7, "z", 7)],
                                 "doc_id long, text string, __id int, __hash string, hash int")
    got = near_dedup(docs)
    assert got.columns == docs.columns and {(r.doc_id, r["__id"], r["__hash"], r["hash"]) for r in got.collect()} == {
        (1, 5, "x", 9), (None, 7, "z", 7)}
