from collections import defaultdict

import pytest

from tidegrid.llm.exact_dedup import exact_dedup


def plain(rows, largest=True):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    known = {t: [i for i in ids if i is not None] for t, ids in groups.items()}
    keep = {t: ((max if largest else min)(ids) if ids else None) for t, ids in known.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""])) for i, t in rows), key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("entries_per_node", [4_000_000, 1])
def test_against_brute_force(edge_docs, keep, entries_per_node):
    got = exact_dedup(edge_docs, keep, fan_in=4, entries_per_node=entries_per_node).collect()
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == plain(rows, keep == "largest")
    # Exactly one row of each text is kept, also where rows repeat.
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).count() == 0


def test_hot_text_is_one_entry_per_run(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text").repartition(8)
    got = exact_dedup(docs, entries_per_node=100)
    assert got.filter("group_size = 2000 and keep_id = 5997").count() == 2000
    assert got.filter("kept").count() == 4001


def test_rounds_follow_from_the_leaf_partitions(spark, tmp_path, monkeypatch):
    from tidegrid.llm import exact_dedup as module

    seen, merge = [], module.merge_runs
    monkeypatch.setattr(module, "merge_runs", lambda d, largest, rounds, fan_in: (
        seen.append((d.rdd.getNumPartitions(), rounds, fan_in)), merge(d, largest, rounds, fan_in))[1])
    # Every leaf file is read as a partition of its own.
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        docs = spark.range(600).selectExpr("id as doc_id", "cast(id % 200 as string) as text").repartition(20)
        got = exact_dedup(docs)
        assert got.filter("kept").count() == 200 and got.filter("group_size = 3").count() == 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (leaves, rounds, fan_in), = seen
    assert rounds > 1 and fan_in**rounds >= leaves > fan_in ** (rounds - 1)
