"""A cleaning session: rules applied, with row counts, scores before and after, and the stored log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.plans.assess import Assessment, assess
from tidegrid.plans.clean import Cleaned, clean
from tidegrid.sheet import Sheets


@dataclass(frozen=True)
class CleaningSession:
    """sessions: one row per sheet; entries: the log with time, operator and runs of rows."""

    cleaned: Cleaned
    sessions: DataFrame
    entries: DataFrame


def _row_counts(sheets: Sheets, name: str) -> DataFrame:
    return sheets.rows.groupBy("sheet_id").agg(F.count("*").alias(name))


def cleaning_session(
    sheets: Sheets,
    rules: list[str],
    operator_id: str,
    at: str | Column,
    before: Assessment | None = None,
    **options,
) -> CleaningSession:
    """Clean, score again and report; ``before`` is an assessment that exists already.

    The score after is that of the cleaned data under the annotations of the upload. A sheet whose
    rows all go has no rows after and no score.
    """
    scores = (before or assess(sheets)).scores
    cleaned = clean(sheets, rules, **options)
    after = assess(cleaned.stored, with_issues=False).scores
    ids = sheets.headers.select("sheet_id").distinct()
    sessions = (
        ids.join(_row_counts(sheets, "rows_before"), "sheet_id", "left")
        .join(_row_counts(cleaned.stored, "rows_after"), "sheet_id", "left")
        .join(scores.select("sheet_id", F.col("total_score").alias("score_before")), "sheet_id", "left")
        .join(after.select("sheet_id", F.col("total_score").alias("score_after")), "sheet_id", "left")
        .na.fill(0, ["rows_before", "rows_after"])
        .select(
            "sheet_id", F.array(*[F.lit(r) for r in rules]).cast("array<string>").alias("rules_applied"),
            "rows_before", "rows_after", "score_before", "score_after",
            F.lit(operator_id).alias("user_id"), F.lit(at).cast("timestamp").alias("created_at"))
    )
    return CleaningSession(cleaned, sessions, cleaned.stored_entries(operator_id, at))
