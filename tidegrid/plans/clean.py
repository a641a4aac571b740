"""The batch cleaning plan: block selection, rules in request order, fills, deletes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import cleaning as cl
from tidegrid.operators.positions import alive_ranks, ranked, reindex
from tidegrid.session import materialize
from tidegrid.sheet import Sheets

RULES = {
    "date_normalize": cl.date_normalize,
    "dedup": cl.dedup,
    "name_normalize": cl.name_normalize,
    "subtotal_remove": cl.subtotal_remove,
    "newline_remove": cl.newline_remove,
    "bracket_note_remove": cl.bracket_note_remove,
    "empty_row_remove": cl.empty_row_remove,
    "empty_col_remove": cl.empty_col_remove,
}
BLOCK_RULE = "multi_table_keep_main"
#: Rules that decide row by row: filters and projections, written with the rule that follows.
ROW_RULES = {"newline_remove", "bracket_note_remove", "subtotal_remove", "empty_row_remove"}
#: Rules that remove rows, which keep their positions until the end.
REMOVING = {"dedup", "subtotal_remove", "empty_row_remove"}


@dataclass(frozen=True)
class Cleaned:
    sheets: Sheets
    logs: list[Callable[[], DataFrame]]

    @cached_property
    def log(self) -> DataFrame:
        """One row per touched row, at the position it had when its rule ran."""
        if not self.logs:
            return cl.audit(self.sheets.rows.limit(0), "", "").withColumn("seq", F.lit(0))
        return reduce(DataFrame.unionByName, [log() for log in self.logs])

    @cached_property
    def stored(self) -> Sheets:
        """The cleaned sheets with their rows written, for readers that need them more than once.

        ``sheets`` numbers the rows anew each time it is read.
        """
        return replace(self.sheets, rows=materialize(self.sheets.rows))

    def entries(self) -> DataFrame:
        return cl.audit_entries(self.log)

    def stored_entries(self, operator_id: str, at: str | Column) -> DataFrame:
        """The entries as a session keeps them: with time, operator, and rows as runs (first, last)."""
        return cl.stored_entries(self.log, operator_id, at)

    def refined(self) -> Sheets:
        """The sheets as their refined files hold them: rows under one header row, without annotations."""
        return replace(self.stored, merged=None, comments=None, strikes=None, leading=None)


def clean(
    sheets: Sheets,
    rules: list[str],
    keep_block: int | None = None,
    remove_columns: list[int] | None = None,
    row_ops: DataFrame | None = None,
) -> Cleaned:
    """Apply rules; ``row_ops`` is ``(sheet_id, row_idx, action)`` on the cleaned positions.

    Rows keep their original positions through all rules, and are numbered anew once: from bitmaps of
    the positions still there. The log counts rows as a rule finds them; those ranks come from the
    bitmaps of the rows before the rule, and only when the log is read. Rules that decide row by row
    are one projection and one write with the rules that follow them; a rule that decides on
    aggregates finds written rows.
    """
    unknown = set(rules) - set(RULES) - {BLOCK_RULE}
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    logs: list[Callable[[], DataFrame]] = []
    pending, sparse = False, False

    def write() -> None:
        nonlocal sheets, pending
        sheets, pending = replace(sheets, rows=materialize(sheets.rows)), False

    def number() -> None:
        nonlocal sheets, sparse
        if sparse:
            write()
            sheets, sparse = replace(sheets, rows=reindex(sheets.rows)), False

    def apply(step, *args, by_row: bool = False, **how) -> None:
        nonlocal sheets, pending, sparse
        if pending and not by_row:
            write()
        before, seq, gaps = sheets.rows, len(logs), sparse
        sheets, log = step(sheets, *args, **how)
        logs.append(lambda: (ranked(log, alive_ranks(before)) if gaps else log).withColumn("seq", F.lit(seq)))
        pending, sparse = True, sparse or how.get("dense") is False

    for _ in range(rules.count(BLOCK_RULE)):
        apply(cl.multi_table_keep, keep_block)
    for rule in rules:
        if rule == "empty_col_remove":
            apply(cl.empty_col_remove, remove_columns)
        elif rule != BLOCK_RULE:
            how = {"dense": False} if rule in REMOVING else {}
            apply(RULES[rule], by_row=rule in ROW_RULES, **how)
    number()
    if row_ops is not None:
        apply(cl.fill_na, row_ops.filter(F.col("action") == "fill_na"))
        apply(cl.delete_rows, row_ops.filter(F.col("action") == "delete"), by_row=True, dense=False)
        number()
    if pending:
        write()
    return Cleaned(sheets, logs)
