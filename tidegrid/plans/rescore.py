"""Scores after edits and removed rows, from the tables of the assessment before and the changed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidegrid.operators import deltas as dl
from tidegrid.operators import profile as pf
from tidegrid.operators import structure as st
from tidegrid.plans.assess import Assessment, score_tables
from tidegrid.session import materialize
from tidegrid.sheet import Sheets


@dataclass(frozen=True)
class ScoreState:
    """An assessment with the counts of equal rows, so that it can follow changes."""

    assessment: Assessment
    groups: DataFrame


def score_state(sheets: Sheets, **options) -> ScoreState:
    """Assess ``sheets`` and keep what a later change needs; ``options`` as for ``assess``."""
    groups = materialize(pf.row_groups(pf.row_facts(sheets)))
    values = materialize(pf.value_counts(sheets))
    summary = materialize(pf.summary_of_groups(groups, sheets.shapes()))
    sparse = materialize(st.sparse_rows(sheets))
    return ScoreState(score_tables(sheets, values, summary, sparse, **options), groups)


def rescore(state: ScoreState, patches: DataFrame, removed: DataFrame, **options) -> ScoreState:
    """The state after a change; equals ``score_state`` of the changed sheet.

    ``patches`` and ``removed`` as in ``operators/deltas.py``; patches of removed rows or of cells
    outside of the sheet have no effect, and a removal counts once. Columns and header stay; the
    annotations are those of the upload. The new state's sheet is a plan over the sheet before:
    write it where many changes follow each other.
    """
    sheets = state.assessment.sheets
    at = removed.select(*dl.ROW).distinct()
    change = dl.Change(sheets, materialize(patches), materialize(
        at.join(sheets.rows.select(*dl.ROW), dl.ROW, "left_semi")))
    values = materialize(dl.value_counts_after(change, state.assessment.values))
    groups = materialize(dl.row_groups_after(change, state.groups))
    sparse = materialize(dl.sparse_rows_after(change, state.assessment.sparse))
    summary = materialize(dl.summary_after(change, groups, sparse))
    return ScoreState(score_tables(change.after(), values, summary, sparse, **options), groups)
