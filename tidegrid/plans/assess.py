"""The assessment plan: profile once, decide on metadata, then score and list issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.operators import duplicates as du
from tidegrid.operators import indicators as ind
from tidegrid.operators import profile as pf
from tidegrid.operators import structure as st
from tidegrid.session import materialize
from tidegrid.sheet import Sheets


@dataclass(frozen=True)
class Assessment:
    """Tables of one assessment job.

    values    distinct values with counts (the only table that grows with the data)
    columns   flagged column profile
    near      near-duplicate pairs
    sparse    blank, nearly blank and top rows
    scores    one row per sheet with indicators, total and status
    """

    sheets: Sheets
    values: DataFrame
    columns: DataFrame
    near: DataFrame
    sparse: DataFrame
    scores: DataFrame

    def result(self) -> DataFrame:
        """sheet_id, sizes, six scores, total, status, row distribution, column details."""
        details = self.columns.groupBy("sheet_id").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("col_idx", "name", "valid_ratio"))),
                lambda d: F.struct(
                    d["name"].alias("name"), d["valid_ratio"].alias("completeness_ratio")
                ),
            ).alias("column_details")
        )
        return self.scores.join(details, "sheet_id", "left").withColumn(
            "column_details",
            F.coalesce("column_details", F.array().cast(details.schema["column_details"].dataType)),
        ).select(
            "sheet_id", F.col("n_rows").alias("total_rows"), *lx.INDICATORS,
            "total_score", "status",
            F.struct("high", "medium", "low").alias("row_distribution"),
            "column_details",
        )


def assess(
    sheets: Sheets,
    weights: dict[str, float] | None = None,
    with_issues: bool = True,
    mode: str = "readiness",
    near_columns: int = du.NEAR_COLUMNS,
    near_values: int = du.NEAR_VALUES,
) -> Assessment:
    """Score every sheet in one job.

    ``near_columns`` and ``near_values`` bound the near-duplicate comparison of
    one sheet; the defaults are those of the scoring rule.
    """
    values = materialize(pf.value_counts(sheets))
    summary = materialize(pf.row_summary(pf.row_facts(sheets), sheets.shapes()))
    sparse = materialize(st.sparse_rows(sheets))
    return score_tables(sheets, values, summary, sparse, weights, with_issues, mode, near_columns, near_values)


def score_tables(
    sheets: Sheets,
    values: DataFrame,
    summary: DataFrame,
    sparse: DataFrame,
    weights: dict[str, float] | None = None,
    with_issues: bool = True,
    mode: str = "readiness",
    near_columns: int = du.NEAR_COLUMNS,
    near_values: int = du.NEAR_VALUES,
) -> Assessment:
    """The assessment from its written tables of values, row counts and sparse rows."""
    columns = materialize(pf.column_flags(pf.column_profile(sheets, values, summary)))
    chosen = du.near_values(sheets, values, du.near_candidates(columns, near_columns), near_values)
    near = materialize(du.near_pairs(chosen))
    sheet = materialize(
        ind.sheet_facts(sheets, columns, sparse, summary, du.near_pair_counts(near))
    )
    scores = ind.scored(ind.indicators(sheet, with_issues), weights, mode)
    return Assessment(sheets, values, columns, near, sparse, scores)
