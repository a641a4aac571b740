import pytest

from tidegrid.operators import lookup as lk
from tidegrid.operators import usage as us


@pytest.fixture(scope="module")
def entries(spark):
    texts = ["Alpha Widget", "widgets", "WIDGET", "wid get", "ab", "", None, "日本語テキスト", "100% sure", "a_b", "İstanbul", "xx widge"]
    rows = [("en" if k % 2 else "zh-TW", f"part.{k}", t) for k, t in enumerate(texts * 3)]
    return spark.createDataFrame(rows, "locale string, key string, value string").repartition(4)


def test_search_equals_the_scan(entries):
    index = lk.trigram_index(entries, ["key", "value"])
    for query in ["widget", "WIDGET", "get", "id", "a", "", "日本語", "語テ", "0% s", "a_b", "part.1", "art.11", "nothing here", "t.7"]:
        want = sorted(map(str, us.search_translations(entries, None, query).collect())) if query else None
        if want is not None:
            assert sorted(map(str, lk.search_text(index, query).collect())) == want, query


def test_names_of_the_tables(spark):
    for table, key, name in (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name")):
        t = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet").selectExpr(f"string({key}) as key", f"{name} as value")
        index = lk.trigram_index(t, ["value"])
        some = [r.value for r in t.orderBy("key").limit(3).collect()]
        for query in [some[0], some[1][2:8], some[2][-5:].upper()]:
            low = query.lower()
            want = t.filter(f"contains(lower(value), '{low}')").count()
            assert lk.search_text(index, query).count() == want > 0


def test_pages_equal_offset_and_limit(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as k", "string(id) as t").repartition(6)
    directory = lk.rank_directory(df, ["-k", "id"], range_rows=300)
    assert directory.ranges.count() > 10
    want = sorted(((-(i % 7), i) for i in range(5000)))
    for page, size in [(1, 20), (15, 20), (16, 20), (50, 100), (250, 20), (251, 20), (0, 0)]:
        offset, limit = us.page_bounds(page, size)
        got = [(-r.k, r.id) for r in directory.page(page, size).collect()]
        assert got == want[offset:offset + limit]
    plan = directory.page(200, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan or "PartitionFilters: [isnotnull(part" in plan
