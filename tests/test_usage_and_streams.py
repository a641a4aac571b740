"""Quota arithmetic, lockout, and the same counts on a stream."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegrid.operators import gate
from tidegrid.operators import usage as us
from tidegrid.streaming import usage as su


def test_period_boundaries(spark):
    df = spark.createDataFrame([("2024-01-17 15:30:00",), ("2024-01-14 16:30:00",)], "t string").select(
        F.col("t").cast("timestamp").alias("t"))
    got = df.select(
        us.period_start(F.col("t"), "daily").cast("string"), us.period_start(F.col("t"), "weekly").cast("string"),
        us.next_reset(F.col("t"), "weekly").cast("string"), us.next_reset(F.col("t"), "daily").cast("string"),
    ).collect()
    assert tuple(got[0]) == ("2024-01-16 16:00:00", "2024-01-14 16:00:00", "2024-01-21 16:00:00", "2024-01-17 16:00:00")
    # Monday 00:30 in Taipei: the week has just begun and the next reset is a week away.
    assert tuple(got[1])[1:3] == ("2024-01-14 16:00:00", "2024-01-21 16:00:00")


def test_lockout_window_is_open_at_its_lower_end(spark):
    start = datetime(2024, 1, 1)
    minutes = [0, 1, 2, 3, 15, 16, 40]
    rows = [("u", start + timedelta(minutes=m), False) for m in minutes]
    df = spark.createDataFrame(rows, "user_id string, attempted_at timestamp, success boolean")
    got = [(r.failures, r.blocked) for r in us.lockout_checks(df).orderBy("attempted_at").collect()]
    assert [f for f, _ in got] == [1, 2, 3, 4, 4, 4, 1]
    assert not any(b for _, b in got)


def test_page_bounds():
    assert us.page_bounds(0, 500) == (0, 20)
    assert us.page_bounds(3, 10) == (20, 10)


def test_gate_blocks_and_names_columns(make_sheet):
    s = make_sheet(["Name", "Age"], [("a", ""), ("b", ""), ("", "3")])
    asked = gate.check_question(s, "what is the AGE?").first()
    assert asked.blocked and "Age (缺漏率 67%)" in asked.explanation
    assert not gate.check_question(s, "name please").first().blocked


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = [("u", datetime(2024, 1, 1, 0, m), False) for m in range(6)] + [("v", datetime(2024, 1, 1, 0, 1), True)]
    df = spark.createDataFrame(rows, "user_id string, attempted_at timestamp, success boolean")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (su.lockout_stream(stream).writeStream.format("memory").queryName("locked")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination(120)
    locked = spark.table("locked")
    assert {r.user_id for r in locked.collect()} == {"u"}
    assert locked.agg(F.max("failures")).first()[0] == 6
