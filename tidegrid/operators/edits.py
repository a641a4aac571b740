"""Interactive cell edits: replace, remark_split, header_rename, delete_row, keep.

``edits`` is a table ``(edit_no, sheet_id, row_idx, col_idx, action, value)``;
``edit_no`` is the request order. Classes run in the fixed order above.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.functions import cells as fx
from tidegrid.operators import cleaning as cl
from tidegrid.session import materialize
from tidegrid.sheet import Sheets

ACTIONS = ["replace", "keep", "delete_row", "remark_split", "header_rename"]


@dataclass(frozen=True)
class Edited:
    sheets: Sheets
    log: DataFrame
    warnings: DataFrame


def edit_violations(edits: DataFrame) -> DataFrame:
    """Edits to reject: unknown actions, and replace or rename without a value."""
    valued = F.col("action").isin("replace", "header_rename")
    unknown = ~F.col("action").isin(ACTIONS)
    return edits.select(
        "*",
        F.when(unknown, F.concat(F.lit("無效的操作類型："), F.col("action")))
        .when(valued & fx.is_empty(F.col("value")), "該操作需要提供新值").alias("message"),
    ).filter(F.col("message").isNotNull())


def _bounds(sheets: Sheets) -> DataFrame:
    sizes = sheets.rows.groupBy("sheet_id").agg(F.count("*").alias("n_rows"))
    return sheets.shapes().select("sheet_id", "n_cols").join(sizes, "sheet_id")


def _checked(edits: DataFrame, sheets: Sheets) -> DataFrame:
    """Adds ``warning`` to edits that point outside the table."""
    c = F.col
    bad_row = (c("row_idx") < 0) | (c("row_idx") >= c("n_rows"))
    bad_col = (c("col_idx") < 0) | (c("col_idx") >= c("n_cols"))
    cell = c("action").isin("replace", "remark_split")
    where = F.when(c("action") == "header_rename", F.format_string("col=%d", "col_idx")).when(
        c("action") == "delete_row", F.format_string("row=%d", "row_idx")
    ).otherwise(F.format_string("row=%d, col=%d", "row_idx", "col_idx"))
    outside = (
        (cell & (bad_row | bad_col))
        | ((c("action") == "header_rename") & bad_col)
        | ((c("action") == "delete_row") & bad_row)
    )
    return edits.join(_bounds(sheets), "sheet_id").withColumn(
        "warning",
        F.when(outside, F.format_string("跳過: %s 指令超出範圍 (%s)", "action", where)),
    )


def patch_cells(sheets: Sheets, patches: DataFrame) -> Sheets:
    """Set cells from ``(sheet_id, row_idx, col_idx, value)``, one patch per cell.

    Patches of a row are one map of at most ``width`` entries; rows join by
    unique position.
    """
    packed = patches.groupBy("sheet_id", "row_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("__patch")
    )
    rows = sheets.rows.join(packed, ["sheet_id", "row_idx"], "left")
    has = lambda i: F.coalesce(F.map_contains_key("__patch", F.lit(i)), F.lit(False))
    return sheets.with_rows(rows.select(
        "sheet_id", "row_idx",
        *[F.when(has(i), F.element_at("__patch", F.lit(i))).otherwise(F.col(f"c{i}")).alias(f"c{i}")
          for i in range(sheets.width)],
    ))


def _with_old_value(sheets: Sheets, edits: DataFrame) -> DataFrame:
    cells = sheets.rows.select(
        "sheet_id", "row_idx", F.array(*sheets.cell_columns).alias("__cells")
    )
    return edits.join(cells, ["sheet_id", "row_idx"]).withColumn(
        "old", F.get("__cells", F.col("col_idx"))
    ).drop("__cells")


def _replace(sheets: Sheets, edits: DataFrame) -> tuple[Sheets, DataFrame]:
    """Later edits of a cell win; each edit logs the value it found."""
    from pyspark.sql import Window as W

    per_cell = W.partitionBy("sheet_id", "row_idx", "col_idx").orderBy("edit_no")
    seen = _with_old_value(sheets, edits).withColumn(
        "old", F.coalesce(F.lag("value").over(per_cell), "old")
    )
    last = edits.groupBy("sheet_id", "row_idx", "col_idx").agg(
        F.max_by("value", "edit_no").alias("value")
    )
    details = F.format_string(
        '儲存格 [%d,%d] 值由 "%s" 修改為 "%s"', "row_idx", "col_idx",
        F.coalesce("old", F.lit("")), "value",
    )
    return patch_cells(sheets, last), cl.audit(seen, "cell_edit", details, F.col("edit_no"))


def _add_remark_column(sheets: Sheets, targets: DataFrame) -> tuple[Sheets, DataFrame]:
    """Sheets that need it get a remark column; returns its position per sheet."""
    shapes = sheets.shapes().select("sheet_id", "n_cols")
    existing = sheets.headers.filter(F.col("name") == lx.REMARK_HEADER).groupBy("sheet_id").agg(
        F.min("col_idx").alias("at")
    )
    where = materialize(
        targets.select("sheet_id").distinct().join(shapes, "sheet_id")
        .join(existing, "sheet_id", "left")
        .select("sheet_id", F.coalesce("at", "n_cols").alias("remark_col"),
                F.col("at").isNull().alias("is_new"))
    )
    widest = where.agg(F.max("remark_col")).first()[0]
    new = where.filter("is_new").select(
        "sheet_id", F.col("remark_col").cast("int").alias("col_idx"),
        F.lit(lx.REMARK_HEADER).alias("name"),
    )
    width = max(sheets.width, 0 if widest is None else widest + 1)
    extra = [F.lit(None).cast("string").alias(f"c{i}") for i in range(sheets.width, width)]
    return replace(
        sheets, rows=sheets.rows.select("*", *extra), width=width,
        headers=sheets.headers.unionByName(new),
    ), where


def _remark_split(sheets: Sheets, edits: DataFrame) -> tuple[Sheets, DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    # The edits of a cell follow each other: a split works on what the one before left.
    def step(state: Column, edit: Column) -> Column:
        before, remark = fx.split_last_remark(state["text"])
        found = F.struct(edit["edit_no"].alias("edit_no"), state["text"].alias("old"),
                         before.alias("before"), remark.alias("remark"))
        return F.struct(before.alias("text"), F.concat(state["steps"], F.array(found)).alias("steps"))

    cell = ["sheet_id", "row_idx", "col_idx"]
    no_steps = F.array().cast("array<struct<edit_no:bigint,old:string,before:string,remark:string>>")
    per_cell = _with_old_value(sheets, edits).groupBy(*cell).agg(
        F.first("old").alias("old"),
        F.array_sort(F.collect_list(F.struct(F.col("edit_no").cast("long").alias("edit_no")))).alias("edits"),
    )
    folded = F.aggregate(
        "edits", F.struct(F.col("old").alias("text"), no_steps.alias("steps")), step, lambda s: s["steps"])
    looked = materialize(per_cell.select(*cell, F.inline(folded)))
    place = F.format_string("(row=%d, col=%d)", "row_idx", "col_idx")
    reason = F.when(fx.is_empty(F.col("old")), "目標儲存格為空").when(
        F.col("remark").isNull(), "未偵測到括號備註"
    )
    warned = looked.withColumn("why", reason).filter(F.col("why").isNotNull()).select(
        "edit_no", "sheet_id",
        F.format_string("跳過: remark_split %s %s", "why", place).alias("warning"),
    )
    done = looked.filter(~fx.is_empty(F.col("old")) & F.col("remark").isNotNull())
    sheets, where = _add_remark_column(sheets, done)
    # Of several splits in one row the last remark stays in the remark column.
    last = W.partitionBy("sheet_id", "row_idx").orderBy(F.desc("edit_no"))
    notes = done.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").join(
        where, "sheet_id"
    ).select("sheet_id", "row_idx", F.col("remark_col").cast("int").alias("col_idx"),
             F.col("remark").alias("value"))
    texts = done.groupBy("sheet_id", "row_idx", "col_idx").agg(F.max_by("before", "edit_no").alias("value"))
    details = F.format_string(
        '儲存格 [%d,%d] 備註分離: "%s" → 結構值="%s", 備註="%s"',
        "row_idx", "col_idx", "old", "before", "remark",
    )
    log = cl.audit(done, "remark_split", details, F.col("edit_no"))
    return patch_cells(sheets, texts.unionByName(notes)), log, warned


def _header_rename(sheets: Sheets, edits: DataFrame) -> tuple[Sheets, DataFrame]:
    last = edits.groupBy("sheet_id", "col_idx").agg(F.max_by("value", "edit_no").alias("new"))
    headers = sheets.headers.join(last, ["sheet_id", "col_idx"], "left").select(
        "sheet_id", "col_idx", F.coalesce("new", "name").alias("name")
    )
    named = edits.drop("row_idx").join(sheets.headers, ["sheet_id", "col_idx"])
    details = F.format_string('欄位 %d 標題由 "%s" 重新命名為 "%s"', "col_idx", "name", "value")
    return replace(sheets, headers=headers), cl.audit(
        named, "header_rename", details, F.col("edit_no")
    )


def apply_edits(sheets: Sheets, edits: DataFrame) -> Edited:
    """Run all edits; refuse the request when any edit is invalid."""
    bad = edit_violations(edits).select("message").first()
    if bad is not None:
        raise ValueError(bad.message)
    checked = materialize(_checked(edits, sheets))
    outside = checked.filter(F.col("warning").isNotNull()).select("edit_no", "sheet_id", "warning")
    good = checked.filter(F.col("warning").isNull()).select(*edits.columns)

    def of(action: str) -> DataFrame:
        return good.filter(F.col("action") == action)

    sheets, log = _replace(sheets, of("replace"))
    logs = [log]
    sheets = replace(sheets, rows=materialize(sheets.rows))
    sheets, log, warned = _remark_split(sheets, of("remark_split"))
    logs.append(log)
    sheets, log = _header_rename(sheets, of("header_rename"))
    logs.append(log)
    sheets, log = cl.delete_rows(sheets, of("delete_row"))
    logs.append(log)
    log = None
    for seq, part in enumerate(logs):
        part = part.withColumn("seq", F.lit(seq))
        log = part if log is None else log.unionByName(part)
    return Edited(sheets, log, outside.unionByName(warned))
