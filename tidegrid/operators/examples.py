"""Example rows for issues: which rows to show, which columns, what to highlight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.functions import cells as fx
from tidegrid.operators.positions import first_rows
from tidegrid.sheet import Sheets

MAX_EXAMPLES = 5
MAX_TYPE_EXAMPLES = 8
MAX_STRUCTURE_EXAMPLES = 10
MAX_DISPLAY_COLUMNS = 6
MAX_MIXED_COLUMNS = 5

EXAMPLE_SCHEMA = (
    "struct<label:string,headers:array<string>,row_number:bigint,cells:array<string>,"
    "highlights:array<int>,merges:array<struct<start_col:int,span:int>>,format_labels:array<string>>"
)


def sheet_layout(sheets: Sheets, flagged: DataFrame) -> DataFrame:
    """sheet_id, n_cols, header_row_index, names, context_col."""
    per_column = flagged.groupBy("sheet_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(
                "col_idx", fx.display_name(F.col("name"), F.col("col_idx")).alias("shown")
            ))),
            lambda x: x["shown"],
        ).alias("names"),
        F.max(F.when(F.col("col_idx") == 0, F.col("is_date_display"))).alias("first_is_date"),
        F.min(F.when(~F.col("is_date_display"), F.col("col_idx"))).alias("first_other"),
    )
    context = F.when(F.col("first_is_date"), F.coalesce("first_other", F.lit(0))).otherwise(0)
    return per_column.join(sheets.shapes(), "sheet_id").select(
        "sheet_id", "n_cols", "header_row_index", "names", context.cast("int").alias("context_col")
    )


def display_columns(problem: Column, context: Column) -> Column:
    """At most six sorted columns: the problem columns, plus the context column if it fits."""
    chosen = F.array_sort(F.array_distinct(problem))
    return F.when(
        F.size(chosen) >= MAX_DISPLAY_COLUMNS, F.slice(chosen, 1, MAX_DISPLAY_COLUMNS)
    ).otherwise(F.array_sort(F.array_union(chosen, F.array(context))))


def first_columns(n_cols: Column) -> Column:
    return F.sequence(F.lit(0), F.least(n_cols, F.lit(MAX_DISPLAY_COLUMNS)) - 1)


def shown_cells(cells: Column, display: Column, width: int = 40) -> Column:
    def one(i: Column) -> Column:
        raw = F.get(cells, i)
        return F.when(fx.is_empty(raw), "").otherwise(fx.truncate(raw, width))

    return F.transform(display, one)


def positions_in(display: Column, flagged: Column) -> Column:
    """Indices into ``display`` of the flagged columns."""
    hit = F.transform(display, lambda c, p: F.when(F.array_contains(flagged, c), p))
    return F.filter(hit, lambda p: p.isNotNull())


def example(
    headers: Column, row_number: Column, cells: Column, highlights: Column,
    label: Column | None = None, merges: Column | None = None, formats: Column | None = None,
) -> Column:
    return F.struct(
        (F.lit("") if label is None else label).alias("label"),
        headers.alias("headers"),
        row_number.cast("long").alias("row_number"),
        cells.alias("cells"),
        F.coalesce(highlights, F.array()).alias("highlights"),
        (F.lit(None) if merges is None else merges).alias("merges"),
        (F.lit(None) if formats is None else formats).alias("format_labels"),
    ).cast(EXAMPLE_SCHEMA)


def problem_columns(flagged: DataFrame, low_threshold: DataFrame, company: DataFrame) -> DataFrame:
    """sheet_id plus one array of column positions per kind; at most ``width`` entries each."""
    c = F.col
    table = flagged.join(low_threshold, "sheet_id").join(
        company.withColumnRenamed("col_idx", "company_col"), "sheet_id", "left"
    )
    kinds = {
        "lowfill": c("fill_ratio") < c("low_threshold"),
        "mixed": c("consistency") < 0.8,
        "placeholder": c("n_placeholder") > 0,
        "mismatch": c("n_mismatch") > 0,
        "remark": c("is_structured") & (c("n_remark") > 0),
        "newline": c("n_newline") > 0,
        "filled": c("n_nonempty") > 0,
        "company": c("col_idx") == c("company_col"),
    }
    lists = [
        F.array_sort(F.collect_set(F.when(cond, c("col_idx")))).alias(k) for k, cond in kinds.items()
    ]
    dominant = F.map_from_entries(F.collect_list(F.struct("col_idx", "dominant_type")))
    return table.groupBy("sheet_id").agg(*lists, dominant.alias("dominant"))


def used_positions(problems: DataFrame) -> dict[str, list[int]]:
    """Positions that occur in any sheet per kind: metadata, bounded by the widest sheet."""
    kinds = [k for k in problems.columns if k not in ("sheet_id", "dominant")]
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("cols")) for k in kinds]))
    pairs = problems.select(listed.alias("p")).select("p.kind", F.explode("p.cols").alias("col_idx"))
    found: dict[str, list[int]] = {k: [] for k in kinds}
    for r in pairs.distinct().collect():
        found[r.kind].append(r.col_idx)
    return {k: sorted(v) for k, v in found.items()}


def flagged_arrays(sheets: Sheets, positions: dict[str, list[int]]) -> dict[str, Column]:
    """Per row and kind, the positions that show the problem; for the few rows that are shown.

    Expects the per-sheet arrays of ``problem_columns`` and ``n_cols`` on the
    row. Only positions that are a problem somewhere get an expression.
    """
    cells = sheets.cell_columns

    def hits(kind: str, predicate) -> Column:
        found = [
            F.when(F.array_contains(kind, i) & predicate(cells[i]), F.lit(i)) for i in positions[kind]
        ]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<int>")

    def filled(predicate):
        return lambda c: ~fx.is_empty(c) & predicate(c)

    empty = [
        F.when((F.col("n_cols") > i) & fx.is_empty(c), F.lit(i)) for i, c in enumerate(cells)
    ]
    return {
        "empty": F.array_compact(F.array(*empty)),
        "lowfill": hits("lowfill", fx.is_empty),
        "placeholder": hits("placeholder", filled(fx.is_placeholder)),
        "mismatch": hits("mismatch", filled(lambda c: ~fx.is_numeric_currency(c))),
        "newline": hits("newline", filled(fx.contains_newline)),
        "subtotal": subtotal_positions(sheets),
    }


def subtotal_positions(sheets: Sheets) -> Column:
    found = [
        F.when(~fx.is_empty(c) & has_subtotal_word(c), F.lit(i)) for i, c in enumerate(sheets.cell_columns)
    ]
    return F.array_compact(F.array(*found))


def has_subtotal_word(c: Column) -> Column:
    return fx.has_word(c, [w for w in lx.SUBTOTAL_EXAMPLE_WORDS if w != "subtotal"])
