"""Raw grids (as read from a workbook) to sheets: merges, header row, hidden columns, annotations.

A grid is ``(sheet_id, row_no, c0..cN)`` with ``row_no`` from 0; annotation
tables use 1-based sheet coordinates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import cells as fx
from tidegrid.session import materialize
from tidegrid.sheet import Sheets

HEADER_SCAN_ROWS = 10
RAW_ROWS_KEPT = 5
STRIKE_SCAN_ROWS = 100
LARGE_ROWS, SMALL_ROWS = 65_536, 256


def _cell_names(grid: DataFrame) -> list[str]:
    return [c for c in grid.columns if c not in ("sheet_id", "row_no")]


def header_score(cells: Column, n_cols: Column) -> Column:
    """How much a row looks like a header; -1 for a blank row."""
    raw = F.transform(cells, lambda c: F.coalesce(c, F.lit("")))
    texts = F.filter(F.transform(raw, fx.trim_ws), lambda v: v != "")

    def score(values: Column) -> Column:
        lowered = F.transform(values, F.lower)
        filled = F.size(values)
        fill = filled / n_cols
        bare = F.transform(values, lambda v: F.replace(v, F.lit(","), F.lit("")))
        typed = F.exists(bare, fx.is_bare_num) | F.exists(values, fx.is_header_date)
        chars = F.aggregate(values, F.lit(0), lambda acc, v: acc + F.length(v))
        mean = chars / filled
        long_cell = F.exists(raw, lambda c: (F.length(c) > 50) | fx.contains_newline(c))
        points = (
            F.when(fill >= 0.8, 30).when(fill >= 0.5, 15).otherwise(0)
            + F.when(typed, 0).otherwise(20)
            + F.when(F.size(F.array_distinct(lowered)) == filled, 20).otherwise(0)
            + F.when((mean >= 2) & (mean <= 20), 15).otherwise(0)
            + F.when(long_cell, 0).otherwise(10)
        )
        return F.when(filled == 0, -1).otherwise(points)

    # An array of one, as the trimmed texts would be made anew at every place that names them.
    return F.get(F.transform(F.array(texts), score), F.lit(0))


def grid_shape(grid: DataFrame) -> DataFrame:
    """sheet_id, n_cols: the widest row."""
    width = F.greatest(F.lit(0), *[
        F.when(F.col(c).isNotNull(), F.lit(i + 1)).otherwise(0) for i, c in enumerate(_cell_names(grid))
    ])
    return grid.groupBy("sheet_id").agg(F.max(width).alias("n_cols"))


def header_scores(grid: DataFrame) -> DataFrame:
    """sheet_id, row_no, score of the first ten rows."""
    top = grid.filter(F.col("row_no") < HEADER_SCAN_ROWS).join(grid_shape(grid), "sheet_id")
    return top.select(
        "sheet_id", "row_no", header_score(F.array(*_cell_names(grid)), F.col("n_cols")).alias("score")
    )


def detect_header(scores: DataFrame) -> DataFrame:
    """sheet_id, header_row: the first row with the highest score, row 0 if all are blank."""
    best = F.max_by("row_no", F.struct(F.col("score"), -F.col("row_no")))
    return scores.groupBy("sheet_id").agg(
        F.when(F.max("score") > -1, best).otherwise(0).cast("int").alias("header_row")
    )


def _buckets(start: Column, end: Column) -> tuple[Column, Column]:
    """Numbers of the large row buckets inside a range, and of the small ones at its two ends.

    A range of any height has at most ``2 * LARGE_ROWS / SMALL_ROWS`` small buckets.
    """
    def numbers(first, last):
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    per = LARGE_ROWS // SMALL_ROWS
    first, last = F.ceil(start / LARGE_ROWS), F.floor((end + 1) / LARGE_ROWS) - 1
    low, high = F.floor(start / SMALL_ROWS), F.floor(end / SMALL_ROWS)
    ends = F.when(first <= last, F.concat(numbers(low, first * per - 1), numbers((last + 1) * per, high)))
    return numbers(first, last), ends.otherwise(numbers(low, high))


def fill_merged(grid: DataFrame, merged: DataFrame) -> DataFrame:
    """Blank cells inside a merged range take the range's top-left value.

    An interval join by row buckets: whole large buckets inside a range are named by number, its ends by
    small buckets; a row looks only at the ranges of its two buckets and checks them. Of the ranges that
    cover a cell and have a value, the one with the smallest number fills it.
    """
    cells = _cell_names(grid)
    numbered = merged if "range_no" in merged.columns else merged.withColumn("range_no", F.lit(0))
    corner = grid.select("sheet_id", (F.col("row_no") + 1).alias("start_row"), F.array(*cells).alias("corner_cells"))
    large, small = _buckets(F.col("start_row").cast("long") - 1, F.col("end_row").cast("long") - 1)
    valued = materialize(numbered.join(corner, ["sheet_id", "start_row"]).withColumn(
        "value", F.get("corner_cells", F.col("start_col") - 1)
    ).filter(F.coalesce("value", F.lit("")) != "").select(
        "sheet_id", F.struct("range_no", "start_row", "start_col", "end_row", "end_col", "value").alias("range"),
        large.alias("large"), small.alias("small")))
    rows = grid
    for name, size in (("large", LARGE_ROWS), ("small", SMALL_ROWS)):
        lists = valued.select("sheet_id", F.explode(name).alias(f"{name}_no"), "range").groupBy(
            "sheet_id", f"{name}_no").agg(F.collect_list("range").alias(f"{name}_ranges"))
        rows = rows.withColumn(f"{name}_no", F.floor(F.col("row_no") / size)).join(
            materialize(lists), ["sheet_id", f"{name}_no"], "left")
    none = F.array().cast(rows.schema["small_ranges"].dataType)
    row = F.col("row_no") + 1
    covering = F.array_sort(F.filter(
        F.concat(F.coalesce("large_ranges", none), F.coalesce("small_ranges", none)),
        lambda r: (r["start_row"] <= row) & (r["end_row"] >= row)))
    rows = rows.select("sheet_id", "row_no", *cells, covering.alias("ranges_of_row"))

    def filled(i: int, name: str) -> Column:
        own = F.filter("ranges_of_row", lambda r: (r["start_col"] <= i + 1) & (r["end_col"] >= i + 1))
        return F.coalesce(
            F.nullif(F.col(name), F.lit("")), F.get(own, F.lit(0))["value"], F.col(name)
        ).alias(name)

    return rows.select("sheet_id", "row_no", *[filled(i, c) for i, c in enumerate(cells)])


def trim_trailing(rows: DataFrame) -> DataFrame:
    """Drop the blank rows after the last row with data."""
    cells = [F.col(c) for c in rows.columns if c.startswith("c")]
    filled = reduce(lambda a, b: a | b, [~fx.is_empty(c) for c in cells])
    last = rows.groupBy("sheet_id").agg(F.max(F.when(filled, F.col("row_idx"))).alias("__last"))
    return rows.join(materialize(last), "sheet_id").filter(F.col("row_idx") <= F.col("__last")).drop("__last")


def visible_columns(grid: DataFrame, hidden: DataFrame | None) -> DataFrame:
    """sheet_id, sheet_col, col_idx; every column when none would stay visible."""
    every = grid_shape(grid).filter("n_cols > 0").select(
        "sheet_id", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("sheet_col")
    )
    if hidden is None:
        return every.withColumn("col_idx", F.col("sheet_col"))
    marks = hidden.select("sheet_id", "sheet_col", F.lit(True).alias("is_hidden")).distinct()
    lists = every.join(marks, ["sheet_id", "sheet_col"], "left").groupBy("sheet_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_hidden").isNull(), F.col("sheet_col")))).alias("shown"),
        F.array_sort(F.collect_list("sheet_col")).alias("all"),
    )
    used = F.when(F.size("shown") > 0, F.col("shown")).otherwise(F.col("all"))
    return lists.select("sheet_id", F.posexplode(used).alias("col_idx", "sheet_col"))


def sheets_from_grid(
    grid: DataFrame,
    merged: DataFrame | None = None,
    hidden: DataFrame | None = None,
    comments: DataFrame | None = None,
    struck: DataFrame | None = None,
) -> Sheets:
    """Apply the workbook rules: merges, header row, hidden columns, trailing rows, annotations."""
    cells = _cell_names(grid)
    filled = grid if merged is None else fill_merged(grid, merged)
    filled = materialize(filled)
    header = materialize(detect_header(header_scores(filled)))
    visible = materialize(visible_columns(filled, hidden))
    picks = visible.groupBy("sheet_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "sheet_col"))), lambda x: x["sheet_col"])
        .alias("__pick")
    )
    width = (visible.agg(F.max("col_idx")).first()[0] or 0) + 1
    empty = grid_shape(filled).filter("n_cols = 0").select("sheet_id")
    lined = filled.join(header, "sheet_id").join(picks, "sheet_id").withColumn("__cells", F.array(*cells))
    title = lined.filter(F.col("row_no") == F.col("header_row"))
    # Headers and leading rows are a few rows per sheet and read by every later step.
    headers = materialize(title.join(visible, "sheet_id").select(
        "sheet_id", "col_idx",
        F.coalesce(F.get("__cells", F.col("sheet_col")), F.lit("")).alias("name"),
    ))
    data = lined.filter(F.col("row_no") > F.col("header_row")).select(
        "sheet_id", (F.col("row_no") - F.col("header_row") - 1).cast("long").alias("row_idx"),
        *[F.get("__cells", F.get("__pick", F.lit(i))).alias(f"c{i}") for i in range(width)],
    )
    rows = materialize(trim_trailing(data))
    leading = materialize(lined.filter(F.col("row_no") <= F.col("header_row")).select(
        "sheet_id", "row_no",
        F.when(F.col("row_no") < RAW_ROWS_KEPT, F.col("__cells"))
        .when(F.col("row_no") == F.col("header_row"),
              F.transform("__pick", lambda i: F.get("__cells", i))).alias("cells"),
    ))
    sizes = rows.groupBy("sheet_id").agg(F.count("*").alias("n_rows"))
    place = header.join(sizes, "sheet_id")

    def mapped(marks: DataFrame | None, limit: int | None = None) -> DataFrame | None:
        """(sheet_id, row, col), 1-based, to data coordinates; marks outside the data drop out."""
        if marks is None:
            return None
        at = marks.join(place, "sheet_id").withColumns({
            "row_idx": (F.col("row") - F.col("header_row") - 2).cast("long"),
            "sheet_col": F.col("col") - 1,
        }).filter((F.col("row_idx") >= 0) & (F.col("row_idx") < F.col("n_rows")))
        if limit is not None:
            at = at.filter(F.col("row_idx") < limit)
        return at.join(visible, ["sheet_id", "sheet_col"]).select("sheet_id", "row_idx", "col_idx")

    return Sheets(
        rows, headers, width, merged, mapped(comments), mapped(struck, STRIKE_SCAN_ROWS), leading, empty
    )
