from tidegrid.operators.keyed_table import BUCKET, keyed_table


def test_one_changed_key_rewrites_one_bucket_and_replays_change_nothing(spark, tmp_path):
    rows = spark.range(500).selectExpr("id % 2 as scope", "id as k", "concat('v', id) as value", "1L as at")
    table = keyed_table(rows, str(tmp_path / "t"), ["scope", "k"], buckets=16)
    files = lambda: {p for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    change = spark.createDataFrame([(1, 7, "new", 5), (1, 7, "older", 4)], "scope long, k long, value string, at long")
    (bucket,) = table.upsert(change, "at")
    kept = {p for p in before if p.parent.name != f"{BUCKET}={bucket}"}
    assert kept <= files() and not (before - kept) & files()
    want = {(i % 2, i, "new" if i == 7 else f"v{i}", 5 if i == 7 else 1) for i in range(500)}
    assert {tuple(r) for r in table.rows().collect()} == want and table.rows().count() == 500
    assert table.upsert(change, "at") == [bucket]
    assert {tuple(r) for r in table.rows().collect()} == want
    stale = spark.createDataFrame([(1, 7, "stale", 2), (0, 1000, "added", 1), (None, None, "null key", 1)],
                                  "scope long, k long, value string, at long")
    table.upsert(stale, "at")
    assert {tuple(r) for r in table.rows().collect()} == want | {(0, 1000, "added", 1), (None, None, "null key", 1)}
    assert table.upsert(stale.limit(0), "at") == []
