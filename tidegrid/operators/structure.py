"""Table-structure operators: gaps, blocks, orphan totals, header-like rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.functions import cells as fx
from tidegrid.operators.positions import next_position, prefix_sum
from tidegrid.session import materialize
from tidegrid.sheet import Sheets

HEADER_SCAN_ROWS = 5


def sparse_rows(sheets: Sheets) -> DataFrame:
    """The rows structure checks look at: at most two filled cells, or near the top."""
    filled = fx.count_true([~fx.is_empty(c) for c in sheets.cell_columns])
    return sheets.rows.withColumn("n_filled", filled).filter(
        (F.col("n_filled") <= 2) | (F.col("row_idx") < HEADER_SCAN_ROWS)
    )


def filled_counts(sheets: Sheets) -> DataFrame:
    filled = fx.count_true([~fx.is_empty(c) for c in sheets.cell_columns])
    return sheets.rows.select("sheet_id", "row_idx", filled.alias("n_filled"))


def data_bounds(facts: DataFrame) -> DataFrame:
    """sheet_id, n_rows, first_data, last_data."""
    data_row = F.when(F.col("n_filled") > 0, F.col("row_idx"))
    return facts.groupBy("sheet_id").agg(
        F.count("*").alias("n_rows"),
        F.min(data_row).alias("first_data"),
        F.max(data_row).alias("last_data"),
    )


def gap_edges(facts: DataFrame) -> DataFrame:
    """Edges of every run of two or more blank rows: sheet_id, row_idx, is_start, is_end.

    Each blank row also marks its two neighbours; one grouping by position then
    tells runs apart without any ordering.
    """
    blank = facts.filter(F.col("n_filled") == 0)
    p = F.col("row_idx")
    marks = blank.select(
        "sheet_id",
        F.explode(
            F.array(
                F.struct(p.alias("row_idx"), F.lit(1).alias("mark")),
                F.struct((p + 1).alias("row_idx"), F.lit(2).alias("mark")),
                F.struct((p - 1).alias("row_idx"), F.lit(4).alias("mark")),
            )
        ).alias("m"),
    ).select("sheet_id", "m.row_idx", "m.mark")
    merged = marks.groupBy("sheet_id", "row_idx").agg(F.sum("mark").alias("marks"))
    # 1 + 4: blank, next blank, previous not; 1 + 2: blank, previous blank, next not.
    return merged.filter(F.col("marks").isin(3, 5)).select(
        "sheet_id", "row_idx",
        (F.col("marks") == 5).alias("is_start"), (F.col("marks") == 3).alias("is_end"),
    )


def gap_summary(facts: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """sheet_id, n_rows, first_data, last_data, post_gap, has_multiple_tables.

    ``facts`` needs the blank rows only when ``bounds`` is given.
    """
    per_sheet = gap_edges(facts).groupBy("sheet_id").agg(
        F.max(F.when(F.col("is_start"), F.col("row_idx"))).alias("last_start"),
        F.min(F.when(F.col("is_end"), F.col("row_idx"))).alias("first_end"),
    )
    bounds = data_bounds(facts) if bounds is None else bounds
    joined = bounds.join(per_sheet, "sheet_id", "left")
    post = F.col("first_end") + 1
    return joined.select(
        "sheet_id", "n_rows", "first_data", "last_data",
        F.when(post <= F.col("last_data"), post).alias("post_gap"),
        F.coalesce(F.col("last_start") > F.col("first_data"), F.lit(False)).alias(
            "has_multiple_tables"
        ),
    )


def data_blocks(facts: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Blocks between gaps: sheet_id, start_row, end_row (exclusive), size, is_main, block_idx.

    ``block_idx`` counts from 0 in row order. ``facts`` needs the blank rows
    only when ``bounds`` is given.
    """
    edges = materialize(gap_edges(facts))
    bounds = materialize(data_bounds(facts)) if bounds is None else bounds
    bounds = bounds.filter(F.col("first_data").isNotNull()).select(
        "sheet_id", "n_rows", "first_data", "last_data"
    )
    after_gap = edges.filter("is_end").join(bounds, "sheet_id").filter(
        (F.col("row_idx") + 1 <= F.col("last_data")) & (F.col("row_idx") >= F.col("first_data"))
    )
    before_gap = edges.filter("is_start").join(bounds, "sheet_id").filter(
        F.col("row_idx") > F.col("first_data")
    )
    turns = (
        bounds.select("sheet_id", F.col("first_data").alias("row_idx"), F.lit(1).alias("starts"))
        .union(after_gap.select("sheet_id", F.col("row_idx") + 1, F.lit(1)))
        .union(before_gap.select("sheet_id", "row_idx", F.lit(0)))
    )
    followed = next_position(turns, "row_idx", "turn")
    blocks = (
        prefix_sum(followed.filter("starts = 1"), "starts", "row_idx", "ordinal")
        .join(bounds.select("sheet_id", "n_rows"), "sheet_id")
        .select(
            "sheet_id",
            (F.col("ordinal") - 1).cast("int").alias("block_idx"),
            F.col("row_idx").alias("start_row"),
            F.coalesce("turn", "n_rows").alias("end_row"),
        )
        .withColumn("size", F.col("end_row") - F.col("start_row"))
    )
    blocks = materialize(blocks)
    main = blocks.groupBy("sheet_id").agg(
        F.max_by("start_row", F.struct(F.col("size"), -F.col("start_row"))).alias("main_start"),
        F.count("*").alias("n_blocks"),
    )
    return blocks.join(main, "sheet_id").select(
        "sheet_id", "block_idx", "start_row", "end_row", "size", "n_blocks",
        (F.col("start_row") == F.col("main_start")).alias("is_main"),
    )


def is_header_like(cells: list[Column]) -> Column:
    values = F.filter(F.array(*[fx.trim_ws(c) for c in cells]), lambda v: F.coalesce(v, F.lit("")) != "")
    lowered = F.transform(values, F.lower)
    return (
        (F.size(values) > 0)
        & F.forall(values, lambda v: fx.format_type(v) == "TEXT")
        & (F.size(F.array_distinct(lowered)) == F.size(lowered))
    )


def multi_layer_headers(rows: DataFrame) -> DataFrame:
    """sheet_id, has_multi_header: more than one header-like row among the first five."""
    cells = [F.col(c) for c in rows.columns if c.startswith("c")]
    return rows.filter(F.col("row_idx") < HEADER_SCAN_ROWS).groupBy("sheet_id").agg(
        (F.count_if(is_header_like(cells)) > 1).alias("has_multi_header")
    )


def has_number(cells: list[Column]) -> Column:
    return fx.any_of([~fx.is_empty(c) & fx.is_num(c) for c in cells])


def orphan_rows(sparse: DataFrame, gaps: DataFrame) -> DataFrame:
    """Rows after the first gap holding at most two values, one of them numeric."""
    after = gaps.filter(F.col("post_gap").isNotNull()).select("sheet_id", "post_gap")
    cells = [F.col(c) for c in sparse.columns if c.startswith("c")]
    return (
        sparse.filter(F.col("n_filled").between(1, 2))
        .join(after, "sheet_id")
        .filter((F.col("row_idx") >= F.col("post_gap")) & has_number(cells))
        .drop("post_gap")
    )


def structure_problems(flags: dict[str, Column]) -> Column:
    """Labels of the present problems, in the fixed order."""
    labels = [F.when(flags[k], F.lit(lx.STRUCTURE_LABELS[k])) for k in lx.STRUCTURE_LABELS]
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def note_location(sheets: Sheets, flagged: DataFrame) -> DataFrame:
    """First note-like cell per sheet: sheet_id, priority, col_idx, row_idx.

    Priorities: newline and CJK note, CJK note, newline (display date columns
    are skipped), then a CJK note in a mostly numeric column.
    """
    cols = flagged.select(
        "sheet_id", "col_idx", "is_date_display",
        (F.col("n_parse") > F.col("n_nonempty") * 0.6).alias("mostly_numeric"),
    )
    raw = F.col("raw")
    note, newline = fx.has_cjk_bracket_note(raw), fx.contains_newline(raw)
    hit = sheets.cells().filter(note | newline).join(cols, ["sheet_id", "col_idx"])
    outside_dates = ~F.col("is_date_display")
    in_number = F.col("mostly_numeric") & note & ~fx.is_num(raw)
    priority = (
        F.when(outside_dates & newline & note, 1)
        .when(outside_dates & note, 2)
        .when(outside_dates & newline, 3)
        .when(in_number, 4)
    )
    best = hit.select("sheet_id", F.struct(priority.alias("priority"), "col_idx", "row_idx").alias("at"))
    return (
        best.filter(F.col("at.priority").isNotNull())
        .groupBy("sheet_id").agg(F.min("at").alias("at")).select("sheet_id", "at.*")
    )
