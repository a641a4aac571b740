"""The quota and lockout counts on streams: the same expressions with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.usage import LOCKOUT_FAILURES, LOCKOUT_MINUTES, QUOTA_ZONE


def usage_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per user and local day."""
    local = events.withColumn("local_ts", F.from_utc_timestamp("ts", QUOTA_ZONE))
    return local.withWatermark("local_ts", late).groupBy(
        "user_id", F.window("local_ts", "1 day").alias("day")
    ).agg(F.count("*").alias("used")).select("user_id", F.col("day.start").alias("local_day"), "used")


def lockout_stream(attempts: DataFrame, late: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Users with too many failures in a sliding 15-minute window."""
    failed = attempts.filter(~F.col("success")).withWatermark("attempted_at", late)
    return failed.groupBy(
        "user_id", F.window("attempted_at", f"{LOCKOUT_MINUTES} minutes", step).alias("w")
    ).agg(F.count("*").alias("failures")).filter(F.col("failures") >= LOCKOUT_FAILURES).select(
        "user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failures"
    )
