"""Data-insufficiency gate for questions, and the prompt snippet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import cells as fx
from tidegrid.operators import profile as pf
from tidegrid.sheet import Sheets

MISSING_THRESHOLD = 0.5
SNIPPET_ROWS = 500


def missing_rates(sheets: Sheets) -> DataFrame:
    """sheet_id, col_idx, name, n_rows, missing_rate; one pass, no shuffle of cells."""
    counts = sheets.rows.groupBy("sheet_id").agg(
        F.count("*").alias("n_rows"),
        F.array(*[F.count_if(fx.is_empty(c)) for c in sheets.cell_columns]).alias("missing"),
    )
    return sheets.headers.join(counts, "sheet_id", "left").select(
        "sheet_id", "col_idx", "name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        (F.get("missing", F.col("col_idx")) / F.col("n_rows")).alias("missing_rate"),
    )


def check_question(sheets: Sheets, question: str, threshold: float = MISSING_THRESHOLD) -> DataFrame:
    """sheet_id, blocked, explanation. Columns named in the question count, else all."""
    named = pf.mentioned_columns(sheets.headers, question).select(
        "sheet_id", "col_idx", F.lit(True).alias("named")
    )
    rates = missing_rates(sheets).join(named, ["sheet_id", "col_idx"], "left")
    any_named = rates.groupBy("sheet_id").agg(F.max("named").alias("any_named"))
    asked = rates.join(any_named, "sheet_id").withColumn(
        "asked", F.coalesce(F.col("named") | F.col("any_named").isNull(), F.lit(False))
    )
    part = F.format_string("%s (缺漏率 %.0f%%)", "name", F.col("missing_rate") * 100)
    bad = F.when(
        F.col("asked") & (F.col("missing_rate") > threshold), F.struct("col_idx", part.alias("t"))
    )
    per_sheet = asked.groupBy("sheet_id").agg(
        F.max("n_rows").alias("n_rows"), F.array_sort(F.collect_list(bad)).alias("bad")
    )
    listed = F.array_join(F.transform("bad", lambda b: b["t"]), "、")
    return per_sheet.select(
        "sheet_id",
        ((F.col("n_rows") == 0) | (F.size("bad") > 0)).alias("blocked"),
        F.when(F.col("n_rows") == 0, "資料不足：資料集中沒有任何資料列")
        .when(F.size("bad") > 0, F.concat(
            F.lit(f"資料不足：以下欄位缺漏率超過 {threshold * 100:.0f}% 門檻值 — "), listed))
        .otherwise("").alias("explanation"),
    )


def prompt_snippet(sheets: Sheets, max_rows: int = SNIPPET_ROWS) -> DataFrame:
    """sheet_id, line_no, line: the header and the first rows joined by commas, unquoted."""
    head = sheets.headers.groupBy("sheet_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "name"))), lambda x: x["name"]),
            ",",
        ).alias("line")
    ).select("sheet_id", F.lit(0).cast("long").alias("line_no"), "line")
    cells = F.slice(F.array(*[F.coalesce(c, F.lit("")) for c in sheets.cell_columns]), F.lit(1), F.col("n_cols"))
    body = sheets.rows.filter(F.col("row_idx") < max_rows).join(
        sheets.shapes().select("sheet_id", "n_cols"), "sheet_id"
    ).select("sheet_id", (F.col("row_idx") + 1).alias("line_no"), F.array_join(cells, ",").alias("line"))
    return head.unionByName(body)
