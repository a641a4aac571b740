"""Cleaning rules: each takes sheets and returns changed sheets plus audit rows.

Audit rows are long, ``(sheet_id, operation_type, item, row_idx, details,
after_count)``, one per touched row, so an operation on billions of rows never
builds one array. Where ``after_count`` is set the sentence is ``details``, the
number of rows and ``after_count``; text of users is never searched for a mark. ``audit_entries`` sums them up, ``audit_lines`` prints them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.functions import cells as fx
from tidegrid.functions.dates import is_normal_date, normalize_date
from tidegrid.operators import entities as en
from tidegrid.operators import structure as st
from tidegrid.operators.positions import reindex, runs
from tidegrid.session import materialize
from tidegrid.sheet import Sheets

EMPTY_COLUMN_RATE = 0.8
Result = tuple[Sheets, DataFrame]


def audit(rows: DataFrame, operation: str, template: str | Column, item: Column | None = None) -> DataFrame:
    """``template`` is a finished sentence, or a fixed text with one ``%d`` for the number of rows."""
    after = None
    if isinstance(template, str):
        before, counted, rest = template.partition("%d")
        template, after = F.lit(before), rest if counted else None
    index = F.col("row_idx") if "row_idx" in rows.columns else F.lit(None).cast("long")
    return rows.select(
        "sheet_id",
        F.lit(operation).alias("operation_type"),
        (F.lit(None).cast("int") if item is None else item.cast("int")).alias("item"),
        index.cast("long").alias("row_idx"),
        template.alias("details"),
        F.lit(after).cast("string").alias("after_count"),
    )


def _column_share(sheets: Sheets, condition: Column) -> DataFrame:
    """sheet_id, col_idx, share of the non-empty cells meeting ``condition`` on ``raw``."""
    return sheets.cells().groupBy("sheet_id", "col_idx").agg(
        (F.count_if(condition) / F.count("*")).alias("share")
    )


def _per_sheet_lists(columns: DataFrame, name: str) -> DataFrame:
    """One array of column positions per sheet; bounded by the sheet width."""
    return columns.groupBy("sheet_id").agg(F.collect_set("col_idx").alias(name))


def _rewrite_cells(sheets: Sheets, columns: DataFrame, change) -> tuple[DataFrame, list[int]]:
    """Rows with ``__changed`` (positions whose text changes) and new cell values.

    ``change`` maps a cell Column to its new value, null for "leave as is".
    Only the positions named in ``columns`` are touched.
    """
    columns = materialize(columns)
    positions = sorted(r.col_idx for r in columns.select("col_idx").distinct().collect())
    if not positions:
        return sheets.rows.withColumn("__changed", F.array().cast("array<int>")), positions
    chosen = _per_sheet_lists(columns, "__cols")
    rows = sheets.rows.join(chosen, "sheet_id", "left")
    updates, changed = {}, []
    for i in positions:
        c = F.col(f"c{i}")
        new = F.when(F.array_contains("__cols", i) & ~fx.is_empty(c), change(c))
        updates[f"__n{i}"] = new
        changed.append(F.when(F.col(f"__n{i}").isNotNull() & (F.col(f"__n{i}") != c), F.lit(i)))
    rows = rows.withColumns(updates).withColumn("__changed", F.array_compact(F.array(*changed)))
    return rows.withColumns({f"c{i}": F.coalesce(f"__n{i}", f"c{i}") for i in positions}).select(
        *sheets.rows.columns, "__changed"
    ), positions


def _by_column(rows: DataFrame) -> DataFrame:
    return rows.select("sheet_id", "row_idx", F.explode("__changed").alias("item"))


def date_normalize(sheets: Sheets) -> Result:
    """Columns whose cells are mostly dates become ``YYYY/MM/DD``."""
    normal = F.when(fx.looks_like_date(fx.trim_ws(F.col("raw"))), is_normal_date(F.col("raw"))).otherwise(False)
    columns = _column_share(sheets, normal).filter("share > 0.5")
    rows, _ = _rewrite_cells(
        sheets, columns,
        lambda c: F.when(fx.looks_like_date(fx.trim_ws(c)), normalize_date(c)),
    )
    item = F.col("item")
    template = F.format_string("統一欄位 %d 的日期格式為 YYYY/MM/DD", item)
    return sheets.with_rows(rows.drop("__changed")), audit(
        _by_column(rows), "date_normalize", template, item
    )


def row_key(sheets: Sheets) -> Column:
    return F.sha2(F.concat(*[
        F.concat(F.coalesce(c, F.lit("")), F.lit("|")) for c in sheets.cell_columns
    ]), 256)


def _after_removal(sheets: Sheets, kept: DataFrame, dense: bool) -> Sheets:
    """With ``dense`` off rows keep their positions, for plans that number them once at the end."""
    return sheets.with_rows(reindex(kept) if dense else kept)


def dedup(sheets: Sheets, dense: bool = True) -> Result:
    """Keep the first of equal rows.

    Groups are reduced to their smallest position with map-side combine; the
    groups with several rows name the positions to remove, and one anti-join
    against these takes them out.
    """
    keyed = sheets.rows.select("sheet_id", "row_idx", F.unhex(row_key(sheets)).alias("key"))
    repeated = keyed.groupBy("sheet_id", "key").agg(
        F.min("row_idx").alias("first"), F.count("*").alias("n")
    ).filter("n > 1").drop("n")
    position = ["sheet_id", "row_idx"]
    removed = materialize(
        keyed.join(repeated, ["sheet_id", "key"]).filter("row_idx > first").select(*position)
    )
    kept = sheets.rows.join(removed, position, "left_anti")
    return _after_removal(sheets, kept, dense), audit(removed, "dedup", "移除 %d 筆完全重複的資料列")


def name_normalize(sheets: Sheets) -> Result:
    """Spellings of one entity become the most frequent spelling (ties: first seen)."""
    text = _column_share(sheets, ~fx.is_num(F.col("raw"))).filter("share > 0.5")
    text = materialize(text.select("sheet_id", "col_idx"))
    named = materialize(en.spellings(sheets, text, join_lines=False))
    mapping = materialize(en.canonical_mapping(named, en.variant_groups(named)))
    columns = materialize(mapping.select("sheet_id", "col_idx").distinct())
    positions = sorted({r.col_idx for r in columns.select("col_idx").distinct().collect()})
    # Only cells that get a new spelling are joined back, all columns of a row at once.
    hits = sheets.cells_of(columns).withColumn("spelling", fx.trim_ws(F.col("raw"))).join(
        mapping.select("sheet_id", "col_idx", "spelling", "canonical"), ["sheet_id", "col_idx", "spelling"]
    ).groupBy("sheet_id", "row_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", "canonical"))).alias("__new")
    )
    rows = sheets.rows.join(hits, ["sheet_id", "row_idx"], "left").withColumns({
        f"c{i}": F.coalesce(F.try_element_at("__new", F.lit(i)), F.col(f"c{i}")) for i in positions
    })
    changed = F.coalesce(F.array_sort(F.map_keys("__new")), F.array().cast("array<int>"))
    rows = rows.withColumn("__changed", changed).select(*sheets.rows.columns, "__changed")
    item = F.col("item")
    template = F.format_string("正規化欄位 %d 的公司名稱，統一為最長變體", item)
    return sheets.with_rows(rows.drop("__changed")), audit(
        _by_column(rows), "name_normalize", template, item
    )


def _remove_rows(sheets: Sheets, condition: Column, operation: str, template: str, dense: bool) -> Result:
    kept = sheets.rows.filter(~condition)
    removed = sheets.rows.filter(condition)
    return _after_removal(sheets, kept, dense), audit(removed, operation, template)


def is_subtotal_row(cells: list[Column], whole_word: bool = False) -> Column:
    return fx.any_of([
        F.coalesce(fx.is_subtotal_cell(c, whole_word), F.lit(False)) for c in cells
    ])


def subtotal_remove(sheets: Sheets, whole_word: bool = False, dense: bool = True) -> Result:
    return _remove_rows(
        sheets, is_subtotal_row(sheets.cell_columns, whole_word),
        "subtotal_remove", "移除 %d 筆小計/合計列", dense,
    )


def is_row_empty(cells: list[Column]) -> Column:
    return fx.all_of([fx.is_empty(c) for c in cells])


def empty_row_remove(sheets: Sheets, dense: bool = True) -> Result:
    return _remove_rows(
        sheets, is_row_empty(sheets.cell_columns), "empty_row_remove", "移除 %d 筆全空資料列", dense
    )


def _rewrite_all(sheets: Sheets, change, operation: str, template: str) -> Result:
    new = {f"__n{i}": F.when(~fx.is_empty(c), change(c)) for i, c in enumerate(sheets.cell_columns)}
    rows = sheets.rows.withColumns(new)
    touched = fx.any_of([
        F.coalesce(F.col(f"__n{i}") != c, F.lit(False)) for i, c in enumerate(sheets.cell_columns)
    ])
    rows = rows.withColumn("__touched", touched).withColumns(
        {f"c{i}": F.coalesce(f"__n{i}", f"c{i}") for i in range(sheets.width)}
    )
    changed = rows.filter("__touched").select("sheet_id", "row_idx")
    return sheets.with_rows(rows.select(*sheets.rows.columns)), audit(changed, operation, template)


def newline_remove(sheets: Sheets) -> Result:
    return _rewrite_all(
        sheets, lambda c: F.replace(c, F.lit("\n"), F.lit(" ")),
        "newline_remove", "移除 %d 列中的儲存格內換行",
    )


def remove_bracket_notes(c: Column) -> Column:
    """Remove the first CJK note of each bracket kind until none is left.

    A cell needs at most as many rounds as it has opening brackets.
    """
    brackets = F.length(F.regexp_replace(c, "[^(（]", ""))
    done = F.aggregate(
        F.sequence(F.lit(1), brackets), c,
        lambda text, _: F.when(
            fx.has_removable_note(text), fx.remove_bracket_notes_once(text)).otherwise(text),
    )
    return fx.trim_ws(F.when(brackets > 0, done).otherwise(c))


def bracket_note_remove(sheets: Sheets) -> Result:
    return _rewrite_all(
        sheets, remove_bracket_notes, "bracket_note_remove", "移除 %d 列中的中文括號備註"
    )


def multi_table_keep(sheets: Sheets, keep_block: int | None = None) -> Result:
    """Keep one block: ``keep_block`` by index where valid, else the largest."""
    blocks = materialize(st.data_blocks(st.filled_counts(sheets)))
    many = blocks.filter("n_blocks > 1")
    chosen = F.col("is_main")
    template = F.format_string("保留最大資料區塊（%d 列），移除其他 %d 列", "size", "n_removed")
    if keep_block is not None and keep_block >= 0:
        valid = F.col("n_blocks") > keep_block
        chosen = F.when(valid, F.col("block_idx") == keep_block).otherwise(F.col("is_main"))
        template = F.format_string("保留使用者選定的資料區塊（%d 列），移除其他 %d 列", "size", "n_removed")
    kept = many.filter(chosen).select("sheet_id", "start_row", "end_row", "size")
    joined = sheets.rows.join(kept, "sheet_id", "left")
    inside = F.col("start_row").isNull() | (
        (F.col("row_idx") >= F.col("start_row")) & (F.col("row_idx") < F.col("end_row"))
    )
    rows = joined.filter(inside).withColumn(
        "row_idx", F.col("row_idx") - F.coalesce("start_row", F.lit(0))
    ).select(*sheets.rows.columns)
    totals = sheets.rows.groupBy("sheet_id").agg(F.count("*").alias("n_rows"))
    counts = kept.join(totals, "sheet_id").withColumn("n_removed", F.col("n_rows") - F.col("size"))
    return sheets.with_rows(rows), audit(
        counts.select("sheet_id", template.alias("t")), "multi_table_keep_main", F.col("t")
    )


def column_fill(sheets: Sheets) -> DataFrame:
    """sheet_id, col_idx, name, n_rows, empty_rate for every column."""
    filled = sheets.rows.groupBy("sheet_id").agg(
        F.count("*").alias("n_rows"),
        F.array(*[F.count_if(~fx.is_empty(c)) for c in sheets.cell_columns]).alias("filled"),
    )
    return sheets.headers.join(filled, "sheet_id").select(
        "sheet_id", "col_idx", "name", "n_rows",
        ((F.col("n_rows") - F.get("filled", F.col("col_idx"))) / F.col("n_rows")).alias("empty_rate"),
    )


def drop_columns(sheets: Sheets, removed: DataFrame, template: str) -> Result:
    """Remove ``(sheet_id, col_idx)``; the columns to the right move left, per sheet."""
    removed = materialize(removed.select("sheet_id", "col_idx", "name"))
    kept = sheets.headers.join(removed, ["sheet_id", "col_idx"], "left_anti")
    order = W.partitionBy("sheet_id").orderBy("col_idx")
    headers = materialize(kept.select(
        "sheet_id", F.col("col_idx").alias("old"),
        (F.row_number().over(order) - 1).cast("int").alias("col_idx"), "name",
    ))
    width = headers.agg(F.max("col_idx")).first()[0]
    width = 0 if width is None else width + 1
    pick = headers.groupBy("sheet_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "old"))), lambda x: x["old"])
        .alias("__pick")
    )
    cells = F.array(*sheets.cell_columns)
    # A sheet that loses all its columns keeps its rows, without cells.
    rows = sheets.rows.join(pick, "sheet_id", "left").select(
        "sheet_id", "row_idx",
        *[F.get(cells, F.get("__pick", F.lit(i))).alias(f"c{i}") for i in range(width)],
    )
    name = F.coalesce(F.nullif(fx.trim_ws(F.col("name")), F.lit("")),
                      F.format_string("第%d欄", F.col("col_idx") + 1))
    listed = removed.groupBy("sheet_id").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", name.alias("name")))).alias("cols")
    )
    details = F.format_string(
        template, F.size("cols"), F.array_join(F.transform("cols", lambda x: x["name"]), "、")
    )
    out = replace(sheets, rows=rows, headers=headers.drop("old"), width=width)
    return out, audit(listed, "empty_col_remove", details)


def empty_col_remove(sheets: Sheets, columns: list[int] | None = None) -> Result:
    """Drop the given positions, or every column that is more than 80 % empty."""
    if columns:
        chosen = sheets.headers.filter(F.col("col_idx").isin(columns))
        return drop_columns(sheets, chosen, "移除 %d 個使用者選定的空缺欄位：%s")
    sparse = column_fill(sheets).filter(F.col("empty_rate") > EMPTY_COLUMN_RATE)
    return drop_columns(sheets, sparse, "移除 %d 個高度空缺欄位：%s")


def fill_na(sheets: Sheets, row_ops: DataFrame) -> Result:
    """Empty cells of the listed rows ``(sheet_id, row_idx)`` become ``N/A``."""
    marked = row_ops.select("sheet_id", "row_idx").distinct().withColumn("__fill", F.lit(True))
    shapes = sheets.shapes().select("sheet_id", F.col("n_cols").alias("__n"))
    rows = sheets.rows.join(marked, ["sheet_id", "row_idx"], "left").join(shapes, "sheet_id")
    hit = [
        F.coalesce(F.col("__fill"), F.lit(False)) & (F.col("__n") > i) & fx.is_empty(c)
        for i, c in enumerate(sheets.cell_columns)
    ]
    filled = rows.withColumn("__touched", fx.any_of(hit)).withColumns({
        n: F.when(h, lx.FILL_VALUE).otherwise(F.col(n)) for n, h in zip(sheets.cell_names, hit)
    })
    touched = rows.filter(fx.any_of(hit)).select("sheet_id", "row_idx")
    index = F.col("row_idx")
    log = audit(
        touched, "fill_na", F.format_string("將第 %d 列的空白儲存格填入 N/A", index), index
    )
    return sheets.with_rows(filled.select(*sheets.rows.columns)), log


def delete_rows(sheets: Sheets, row_ops: DataFrame, dense: bool = True) -> Result:
    """Remove rows by position; positions outside the table are ignored."""
    chosen = row_ops.select("sheet_id", "row_idx").distinct()
    position = ["sheet_id", "row_idx"]
    kept = sheets.rows.join(chosen, position, "left_anti")
    gone = sheets.rows.select(*position).join(chosen, position, "left_semi")
    index = F.col("row_idx")
    log = audit(gone, "delete_row", F.format_string("刪除第 %d 列", index), index)
    return _after_removal(sheets, kept, dense), log


def stored_entries(log: DataFrame, operator_id: str, at: str | Column) -> DataFrame:
    """seq, sheet_id, operation_type, item, n_rows, details, first, last, timestamp, operator_id.

    One row per run of consecutive touched rows, so an entry over any stretch of rows is one row;
    ``first`` and ``last`` are null for an entry that names no rows.
    """
    keys = ["seq", "sheet_id", "operation_type", "item"]
    stretches = runs(log, keys).select(*[F.col(k).alias(f"of_{k}") for k in keys], "first", "last")
    entries = audit_entries(log)
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return entries.join(stretches, same, "left").select(
        *entries.columns, "first", "last", F.lit(at).cast("timestamp").alias("timestamp"), F.lit(operator_id).alias("operator_id"))


def audit_entries(log: DataFrame) -> DataFrame:
    """One row per rule application: seq, sheet_id, operation_type, item, n_rows, details."""
    n = F.count("row_idx")
    counted = F.concat("details", F.col("n_rows").cast("string"), "after_count")
    return log.groupBy("seq", "sheet_id", "operation_type", "item", "details", "after_count").agg(
        n.alias("n_rows")
    ).select(
        "seq", "sheet_id", "operation_type", "item", "n_rows",
        F.coalesce(counted, F.col("details")).alias("details"),
    )


def removal_preview(sheets: Sheets, sample_rows: int = 15, block_rows: int = 10) -> dict[str, DataFrame]:
    """What could be removed: columns with empty rates, blocks, and sample rows."""
    columns = column_fill(sheets).select(
        "sheet_id", "col_idx",
        F.coalesce(F.nullif(fx.trim_ws(F.col("name")), F.lit("")),
                   F.format_string("第%d欄", F.col("col_idx") + 1)).alias("col_name"),
        "empty_rate", (F.col("empty_rate") > EMPTY_COLUMN_RATE).alias("is_removable"),
    )
    blocks = materialize(st.data_blocks(st.filled_counts(sheets)).filter("n_blocks > 1"))
    shown = F.array(*[
        fx.truncate(F.replace(F.when(fx.is_empty(c), "").otherwise(c), F.lit("\n"), F.lit(" ")), 20)
        for c in sheets.cell_columns
    ])
    samples = sheets.rows.filter(F.col("row_idx") < sample_rows).select(
        "sheet_id", "row_idx", shown.alias("cells")
    )
    heads = blocks.select(
        "*",
        F.explode(F.sequence(
            F.col("start_row"), F.least(F.col("end_row"), F.col("start_row") + block_rows) - 1
        )).alias("row_idx"),
    )
    filled = F.filter(F.array(*sheets.cell_columns), lambda c: ~fx.is_empty(c))
    first = F.array_join(F.slice(filled, 1, 3), " | ")
    cut = F.when(
        F.octet_length(first) > 60,
        F.concat(F.decode(F.substring(F.encode(first, "UTF-8"), 1, 57), "UTF-8"), F.lit("...")),
    ).otherwise(first)
    block_samples = heads.join(sheets.rows, ["sheet_id", "row_idx"]).select(
        "sheet_id", "block_idx", "row_idx", shown.alias("cells"),
        F.when(F.col("row_idx") == F.col("start_row"), cut).alias("preview"),
    )
    previews = block_samples.filter(F.col("preview").isNotNull()).select(
        "sheet_id", "block_idx", "preview"
    )
    listed = blocks.join(previews, ["sheet_id", "block_idx"], "left").select(
        "sheet_id", "block_idx", (F.col("start_row") + 1).alias("start_row"),
        F.col("end_row"), F.col("size").alias("row_count"), "is_main", "preview",
    )
    return {
        "columns": columns, "blocks": listed, "samples": samples,
        "block_samples": block_samples.drop("preview"),
    }
