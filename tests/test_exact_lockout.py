"""Streamed lock states against the batch query, attempt by attempt."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegrid.operators import usage as us
from tidegrid.streaming.lockout import exact_lockout_stream, judge

SCHEMA = "user_id string, attempted_at timestamp, success boolean"
START = datetime(2024, 1, 1)


def replay(spark, folder, batches, name, **options):
    """Run the stream over ``batches`` in their order, one file each."""
    source = folder / "in"
    for no, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        for path in source.glob("part-*.parquet"):
            if path.name not in {p.name for p in (folder / "seen").glob("*")}:
                (folder / "seen").mkdir(exist_ok=True)
                (folder / "seen" / path.name).touch()
                os.utime(path, (1_700_000_000 + no, 1_700_000_000 + no))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (exact_lockout_stream(stream, **options).writeStream.format("memory").queryName(name)
             .option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start())
    assert query.awaitTermination(240)
    return spark.table(name)


def test_equals_the_batch_query_with_late_rows(spark, tmp_path):
    pick = random.Random(3)
    rows = [(pick.choice("uvw"), START + timedelta(seconds=20 * pick.randrange(0, 200)), pick.random() < 0.3)
            for _ in range(160)]
    rows.sort(key=lambda r: r[1] + timedelta(seconds=pick.randrange(0, 240)))
    batches = [rows[i:i + 40] for i in range(0, 160, 40)]
    end = [("end", START + timedelta(days=1), True)]
    got = replay(spark, tmp_path, [*batches, end], "exact_locked")
    want = us.lockout_checks(spark.createDataFrame(rows, SCHEMA)).drop("failures")
    columns = ["user_id", "attempted_at", "success", "blocked"]
    got = sorted(map(tuple, got.select(*columns).collect()))
    assert got == sorted(map(tuple, want.select(*columns).collect()))
    assert any(r[3] for r in got) and not all(r[3] for r in got)


def test_too_late_and_incomplete_attempts_are_dropped(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    batches = [[("u", at(60), False), (None, at(60), False), ("u", None, False)],
               [("v", at(62), None)], [("u", at(1), False)], [("end", at(900), True)]]
    got = replay(spark, tmp_path, batches, "late_locked", max_failures=1)
    assert sorted(map(tuple, got.collect())) == [("u", at(60), False, True), ("v", at(62), True, False)]


def test_the_window_is_open_below():
    attempts = [(0, False), (5, False), (10, True), (10, False), (11, True)]
    out, failures = judge(attempts, [], 2, 10)
    assert [b for _, b in out] == [False, True, True, True, True]
    assert failures == [5, 10]
    assert judge([(10, True)], [0, 0], 2, 10)[0] == [((10, True), False)]
    assert judge([], [1], 2, 10) == ([], [1])
