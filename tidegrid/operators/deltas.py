"""Count tables kept up to date by signed deltas: what changed rows held goes, what they hold now comes.

A change is ``patches`` (sheet_id, row_idx, col_idx, value; one per cell, null empties it) and
``removed`` (sheet_id, row_idx, once each). Positions are those of the sheet before the change and
dense from 0. Only the changed rows of the sheet are read, except for what sums cannot tell: the
first row of a value whose first holder went, the first rows of the sheet, and after removals the
positions of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import profile as pf
from tidegrid.operators import structure as st
from tidegrid.operators.edits import patch_cells
from tidegrid.operators.positions import alive_ranks, first_rows, ranked, runs
from tidegrid.session import materialize
from tidegrid.sheet import Sheets

ROW = ["sheet_id", "row_idx"]
VALUE = ["sheet_id", "col_idx", "value", "is_long"]
GROUP = ["sheet_id", "row_key", "n_cols", "n_filled"]


@dataclass(frozen=True)
class Change:
    """One change of a sheet; the tables are written, as several steps read them."""

    sheets: Sheets
    patches: DataFrame
    removed: DataFrame

    @cached_property
    def touched(self) -> DataFrame:
        """sheet_id, row_idx, gone: every changed row once."""
        gone = self.removed.select(*ROW, F.lit(True).alias("gone"))
        edited = self.patches.select(*ROW, F.lit(False).alias("gone"))
        return materialize(gone.unionByName(edited).groupBy(*ROW).agg(F.max("gone").alias("gone")))

    @cached_property
    def old(self) -> DataFrame:
        """The changed rows as they were, with ``gone``."""
        return materialize(self.sheets.rows.join(self.touched, ROW))

    @cached_property
    def new(self) -> DataFrame:
        """The changed rows that stay, as they are now."""
        stay = self.sheets.with_rows(self.old.filter(~F.col("gone")).drop("gone"))
        return materialize(patch_cells(stay, self.patches).rows)

    @cached_property
    def has_removals(self) -> bool:
        return not self.removed.isEmpty()

    def signed(self, view) -> DataFrame:
        """``view`` of the changed rows before (sign -1) and after (sign 1)."""
        before = view(self.sheets.with_rows(self.old.drop("gone"))).withColumn("sign", F.lit(-1))
        return before.unionByName(view(self.sheets.with_rows(self.new)).withColumn("sign", F.lit(1)))

    def live(self, sheets: Sheets | None = None) -> Sheets:
        """The sheet after the change at the old positions."""
        rows = (sheets or self.sheets).rows
        if self.has_removals:
            rows = rows.join(self.removed.select(*ROW), ROW, "left_anti")
        return patch_cells(self.sheets.with_rows(rows), self.patches)

    @cached_property
    def ranks(self) -> DataFrame:
        """Rank bitmaps of the rows that stay; only positions are read."""
        return materialize(alive_ranks(
            self.sheets.rows.select(*ROW).join(self.removed.select(*ROW), ROW, "left_anti")))

    def moved(self, df: DataFrame, position: str = "row_idx") -> DataFrame:
        """Old positions replaced by those after the removals."""
        if not self.has_removals:
            return df
        named = df if position == "row_idx" else df.withColumnRenamed(position, "row_idx")
        return ranked(named, self.ranks).select(
            *[F.col("row_idx" if c == position else c).alias(c) for c in df.columns])

    @cached_property
    def top(self) -> Sheets:
        """The first rows after the change, at their new positions.

        A row among them stood before at most as many places further down as rows of its sheet went.
        """
        limit, shift = pf.TIME_SAMPLE_ROWS, 0
        if self.has_removals:
            shift = self.removed.groupBy("sheet_id").count().agg(F.max("count")).first()[0]
        near = self.sheets.rows.filter(F.col("row_idx") < limit + shift)
        rows = self.live(self.sheets.with_rows(near)).rows
        first = first_rows(rows, ["sheet_id"], ["row_idx"], limit)
        return self.sheets.with_rows(materialize(
            first.withColumn("row_idx", (F.col("rank") - 1).cast("long")).drop("rank")))

    def after(self) -> Sheets:
        """The sheet after the change, with dense positions."""
        live = self.live()
        return live.with_rows(self.moved(live.rows))


def _split(counts: DataFrame, delta: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(counts the delta leaves alone, delta with the counts it meets as ``held``).

    The delta is the small side of both joins, so the counts need no shuffle where its file size
    allows a broadcast.
    """
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    a, b = counts.alias("a"), delta.select(*keys).alias("b")
    alone = a.join(b, on, "left_anti")
    met = materialize(a.join(b, on, "left_semi"))
    held = met.select(*keys, F.struct(*[c for c in met.columns if c not in keys]).alias("held"))
    both = delta.alias("a").join(held.alias("b"), on, "left").select("a.*", "b.held")
    return alone, both


def _count(both_n: Column, dn: Column) -> Column:
    n = F.coalesce(both_n, F.lit(0)) + dn
    return F.when(n >= 0, n).otherwise(F.raise_error(F.lit("the change takes away what the counts do not hold")))


def value_counts_after(change: Change, counts: DataFrame) -> DataFrame:
    """``value_counts`` of the sheet after the change, from those before."""
    row = F.col("row_idx")
    cells = change.signed(pf.value_cells)
    delta = materialize(pf.value_facts(
        cells.groupBy(*pf.VALUE_CELL_KEYS).agg(
            F.sum("sign").cast("long").alias("dn"),
            F.min(F.when(F.col("sign") > 0, row)).alias("came"),
            F.min(F.when(F.col("sign") < 0, row)).alias("went")),
        "dn", "came", "went"))
    alone, both = _split(counts, delta, VALUE)
    first = F.col("held.first_row")
    holder_went = (F.col("went") == first) & (F.col("came").isNull() | (F.col("came") > first))
    merged = materialize(both.withColumn("n", _count(F.col("held.n"), F.col("dn"))).filter("n > 0").withColumn(
        "first_row", F.when(~F.coalesce(holder_went, F.lit(False)), F.least(first, "came"))
    ).select(*VALUE, "n", "first_row", "came", "mask", "n_chars"))
    lost = materialize(merged.filter(F.col("first_row").isNull()).select(*VALUE))
    if not lost.isEmpty():
        merged = _with_first_rows(change, merged, lost)
    kept = ["n", "first_row", "mask", "n_chars"]
    out = change.moved(alone.select(*VALUE, *kept).unionByName(merged.select(*VALUE, *kept)), "first_row")
    sample = pf.value_cells(change.top).groupBy(
        "sheet_id", "col_idx", "value", F.col("long_mask").isNotNull().alias("is_long")
    ).agg(F.count("*").alias("n_first100"))
    return out.join(materialize(sample), VALUE, "left").na.fill(0, ["n_first100"]).select(*counts.columns)


def _with_first_rows(change: Change, merged: DataFrame, lost: DataFrame) -> DataFrame:
    """First rows of values whose first holder went: the changed rows are known, the others are searched.

    Lost values are looked up as they stand, so no cell needs to be tested for being blank.
    """
    columns = sorted(r.col_idx for r in lost.select("col_idx").distinct().collect())
    others = change.sheets.rows.join(change.touched.select(*ROW), ROW, "left_anti")
    raw = F.col("raw")
    is_long = F.octet_length(raw) > pf.LONG_VALUE_BYTES
    cells = others.unpivot(ROW, [f"c{i}" for i in columns], "name", "raw").filter(raw.isNotNull()).select(
        *ROW, F.substr(F.col("name"), F.lit(2)).cast("int").alias("col_idx"),
        F.when(is_long, F.sha2(raw, 256)).otherwise(raw).alias("value"), is_long.alias("is_long"))
    found = cells.join(lost, VALUE, "left_semi").groupBy(*VALUE).agg(F.min("row_idx").alias("found"))
    return merged.join(materialize(found), VALUE, "left").withColumn(
        "first_row", F.coalesce("first_row", F.least("came", "found")))


def row_groups_after(change: Change, groups: DataFrame) -> DataFrame:
    """Counts of equal rows after the change: the columns of ``GROUP`` and ``n``."""
    facts = change.signed(pf.row_facts).withColumn(
        "row_key", F.when(F.col("n_filled") > 0, F.col("row_key")))
    delta = materialize(facts.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("dn")).filter("dn <> 0"))
    alone, both = _split(groups.select(*GROUP, "n"), delta, GROUP)
    merged = both.withColumn("n", _count(F.col("held.n"), F.col("dn"))).filter("n > 0").select(*GROUP, "n")
    return alone.unionByName(merged)


def sparse_rows_after(change: Change, sparse: DataFrame) -> DataFrame:
    """``sparse_rows`` of the sheet after the change."""
    kept = sparse.join(change.touched.select(*ROW), ROW, "left_anti")
    came = st.sparse_rows(change.sheets.with_rows(change.new)).select(*kept.columns)
    below = change.moved(kept.unionByName(came)).filter(
        (F.col("n_filled") <= 2) & (F.col("row_idx") >= st.HEADER_SCAN_ROWS))
    above = change.top.with_rows(change.top.rows.filter(F.col("row_idx") < st.HEADER_SCAN_ROWS))
    return below.select(*sparse.columns).unionByName(st.sparse_rows(above).select(*sparse.columns))


def summary_after(change: Change, groups: DataFrame, sparse: DataFrame) -> DataFrame:
    """``row_summary`` from counts of equal rows; the data begins and ends beside the outer runs of blank rows."""
    nothing = F.lit(None).cast("long")
    summary = pf.summary_of_groups(
        groups.withColumn("lo", nothing).withColumn("hi", nothing), change.sheets.shapes())
    blank = runs(sparse.filter(F.col("n_filled") == 0), ["sheet_id"])
    outer = blank.join(summary.select("sheet_id", "n_rows"), "sheet_id").groupBy("sheet_id").agg(
        F.max(F.when(F.col("first") == 0, F.col("last") + 1)).alias("__start"),
        F.min(F.when(F.col("last") == F.col("n_rows") - 1, F.col("first") - 1)).alias("__end"))
    start = F.coalesce("__start", F.lit(0).cast("long"))
    has_data = (F.col("n_rows") > 0) & (start < F.col("n_rows"))
    return summary.drop("first_data", "last_data").join(outer, "sheet_id", "left").withColumn(
        "first_data", F.when(has_data, start)
    ).withColumn("last_data", F.when(has_data, F.coalesce("__end", F.col("n_rows") - 1))).select(*summary.columns)
