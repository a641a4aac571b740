"""The lock state of every attempt on a stream, exact in event time.

``lockout_stream`` in ``usage.py`` counts in windows that begin every minute; here each attempt is
judged by the failures in the window that ends with it, as in ``operators.usage.lockout_checks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.operators.usage import LOCKOUT_FAILURES, LOCKOUT_MINUTES

STATE = "waiting array<bigint>, succeeded array<boolean>, failures array<bigint>"
VERDICT = "user_id string, us bigint, success boolean, blocked boolean"


def judge(waiting: list[tuple[int, bool]], failures: list[int], most: int, span: int):
    """(attempt, blocked) of attempts in order of time, and the last ``most`` failures after them.

    Attempts of one moment see each other's failures. The window is open at its lower end, so the
    user is blocked when the ``most``-th last failure lies less than ``span`` back.
    """
    out, at = [], 0
    while at < len(waiting):
        now = waiting[at][0]
        end = at
        while end < len(waiting) and waiting[end][0] == now:
            end += 1
        failed = sum(not success for _, success in waiting[at:end])
        failures = (failures + [now] * min(failed, most))[-most:]
        blocked = len(failures) == most and failures[0] > now - span
        out += [(attempt, blocked) for attempt in waiting[at:end]]
        at = end
    return out, failures


def exact_lockout_stream(
    attempts: DataFrame,
    late: str = "5 minutes",
    max_failures: int = LOCKOUT_FAILURES,
    minutes: int = LOCKOUT_MINUTES,
) -> DataFrame:
    """user_id, attempted_at, success, blocked: one row per attempt, once the watermark has passed it.

    ``attempts`` is a stream of (user_id, attempted_at, success); an attempt that arrives later than
    ``late`` behind the newest one is dropped, an attempt without a user or time as well; a null
    ``success`` counts as no failure. A user's state is the last ``max_failures`` failures and the
    attempts of the last ``late`` that wait for their order to be settled. An attempt stays waiting
    until a later one moves the watermark.
    """
    span = minutes * 60 * 1_000_000

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, successes, failures = state.get if state.exists else ([], [], [])
        waiting = list(zip(times, successes))
        for batch in batches:
            waiting += zip(batch["us"].tolist(), batch["success"].tolist())
        waiting.sort()
        watermark = state.getCurrentWatermarkMs()
        # Rows at or before the watermark, in whole milliseconds, are late: no more of them can come.
        settled = [a for a in waiting if a[0] // 1000 <= watermark]
        waiting = waiting[len(settled):]
        judged, failures = judge(settled, list(failures), max_failures, span)
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, watermark + 1))
        elif failures:
            # Nothing of the last failures counts after the window has gone by.
            state.setTimeoutTimestamp(max((failures[-1] + span) // 1000 + 1, watermark + 1))
        if waiting or (failures and failures[-1] + span > watermark * 1000):
            state.update(([t for t, _ in waiting], [s for _, s in waiting], failures))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(
            [(key[0], us, success, blocked) for (us, success), blocked in judged],
            columns=["user_id", "us", "success", "blocked"])

    marked = attempts.filter(F.col("user_id").isNotNull() & F.col("attempted_at").isNotNull()).select(
        F.col("user_id").cast("string").alias("user_id"), "attempted_at",
        F.coalesce("success", F.lit(True)).alias("success"),
        F.unix_micros(F.col("attempted_at")).alias("us"),
    ).withWatermark("attempted_at", late)
    followed = marked.groupBy("user_id").applyInPandasWithState(
        follow, VERDICT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return followed.select("user_id", F.timestamp_micros("us").alias("attempted_at"), "success", "blocked")
