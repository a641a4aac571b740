"""The six indicators and the total score, one row per sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.functions.cells import round1
from tidegrid.operators import profile as pf
from tidegrid.operators import structure as st
from tidegrid.sheet import Sheets


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if set(weights) != set(lx.INDICATORS) or any(w < 0 for w in weights.values()):
        raise ValueError("weights must name the six indicators and not be negative")
    if abs(sum(weights.values()) - 1.0) >= 0.001:
        raise ValueError("weights must sum to 1.0 (±0.001)")
    return weights


def resolve_weights(settings: DataFrame, value: str = "value") -> DataFrame:
    """Weights from a JSON setting, or the defaults when missing or not summing to 1."""
    schema = ", ".join(f"{k} double" for k in lx.INDICATORS)
    parsed = settings.select("*", F.from_json(value, schema).alias("w"))
    total = sum_columns([F.coalesce(F.col(f"w.{k}"), F.lit(0.0)) for k in lx.INDICATORS])
    valid = F.abs(total - 1.0) < 0.001
    return parsed.select(
        *settings.columns,
        *[
            F.when(valid, F.coalesce(F.col(f"w.{k}"), F.lit(0.0)))
            .otherwise(F.lit(v)).alias(k)
            for k, v in lx.DEFAULT_WEIGHTS.items()
        ],
    )


def sum_columns(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def grade(total: Column) -> Column:
    return F.when(total >= 80, "ready").when(total >= 60, "conditional").otherwise("not_ready")


def weighted(weights: dict[str, float]) -> Column:
    return sum_columns([F.col(k) * F.lit(weights[k]) for k in lx.INDICATORS])


def total_score(weights: dict[str, float], mode: str = "readiness") -> Column:
    """``plain``: weighted indicators; ``readiness``: 60 % of that, 40 % share of high rows."""
    base = weighted(check_weights(weights))
    if mode == "plain":
        return round1(base)
    rows = F.col("high") + F.col("medium") + F.col("low")
    high = F.when(rows > 0, F.col("high") / rows).otherwise(0.0)
    return round1(base * 0.6 + high * 100 * 0.4)


def column_rollup(flagged: DataFrame) -> DataFrame:
    """Column flags summed up per sheet."""
    c = F.col

    def any_(name: str) -> Column:
        return F.max(c(name)).alias(f"any_{name}")

    return flagged.groupBy("sheet_id").agg(
        F.avg("valid_ratio").alias("avg_valid"),
        F.avg("consistency").alias("avg_consistency"),
        F.sum("n_nonempty").alias("n_nonempty_cells"),
        F.sum("n_valid").alias("n_valid_cells"),
        F.sum("n_placeholder").alias("n_placeholders"),
        F.sum("n_mismatch").alias("n_mismatches"),
        (F.sum("n_subtotal") > 0).alias("has_subtotal"),
        *[
            any_(f)
            for f in (
                "is_identifier", "is_time", "is_category", "is_numeric",
                "is_newline_heavy", "has_notes", "is_remark_dense",
            )
        ],
    )


def annotation_flags(sheets: Sheets, flags: DataFrame) -> DataFrame:
    for name, table in (
        ("has_merged", sheets.merged), ("has_comment", sheets.comments), ("has_strike", sheets.strikes)
    ):
        if table is None:
            flags = flags.withColumn(name, F.lit(False))
        else:
            present = table.select("sheet_id", F.lit(True).alias(name)).distinct()
            flags = flags.join(present, "sheet_id", "left").na.fill(False, [name])
    return flags


def sheet_facts(
    sheets: Sheets, flagged: DataFrame, sparse: DataFrame, summary: DataFrame, n_near: DataFrame
) -> DataFrame:
    """Everything the indicators need, one row per sheet."""
    gaps = st.gap_summary(sparse, summary)
    orphans = st.orphan_rows(sparse, gaps).groupBy("sheet_id").agg(F.count("*").alias("n_orphans"))
    dist = pf.row_distribution(sheets, summary)
    out = (
        summary.drop("high", "medium", "low")
        .join(dist, "sheet_id", "left")
        .join(column_rollup(flagged), "sheet_id", "left")
        .join(gaps.select("sheet_id", "post_gap", "has_multiple_tables"), "sheet_id", "left")
        .join(orphans, "sheet_id", "left")
        .join(st.multi_layer_headers(sparse), "sheet_id", "left")
        .join(pf.header_quality(sheets.headers), "sheet_id", "left")
        .join(n_near, "sheet_id", "left")
        .na.fill(0, [
            "n_orphans", "n_near", "high", "medium", "low", "avg_valid", "n_nonempty_cells", "n_valid_cells",
            "n_placeholders", "n_mismatches",
        ])
    )
    flags = [name for name, kind in out.dtypes if kind == "boolean"]
    out = out.na.fill(False, flags)
    return annotation_flags(sheets, out)


def _points(flag: Column, points: int) -> Column:
    return F.when(flag, points).otherwise(0)


def indicators(sheet: DataFrame, with_issues: bool = True) -> DataFrame:
    """Adds the six indicators; ``with_issues`` applies the issue penalties."""
    c = F.col
    cells = (c("n_rows") * c("n_cols")).cast("double")
    has_cells = cells > 0
    base_format = F.coalesce(c("avg_consistency") * 100, F.lit(100.0))
    penalty = F.least(
        F.lit(1.0),
        (c("n_placeholders") * 5.0 + c("n_mismatches") * 3.0) / c("n_nonempty_cells"),
    )
    near = F.least(c("n_near"), c("n_rows"))
    duplicate_ratio = (c("n_exact_duplicates") + near * 0.5) / c("n_rows")
    filled = 1.0 - (cells - c("n_filled_cells")) / cells
    notes = c("any_has_notes") | c("has_comment") | c("has_strike")
    structure = (
        F.lit(100.0)
        - _points(c("has_merged"), 20)
        - _points(c("has_multi_header"), 20)
        - _points(c("has_subtotal"), 15)
        - _points(c("has_multiple_tables"), 25)
        - _points(notes, 10)
        - _points(c("any_is_newline_heavy"), 5)
        - _points(c("has_strike"), 10)
    )
    named = c("good_names")
    readiness = (
        _points(c("any_is_identifier"), 20)
        + _points(c("any_is_time"), 20)
        + _points(c("any_is_category"), 20)
        + _points(c("any_is_numeric"), 20)
    )
    if with_issues:
        structure = (
            structure
            - _points((c("n_orphans") > 0) & ~c("has_subtotal"), 20)
            - _points(c("any_is_remark_dense") & ~notes, 15)
        )
        readiness = (
            readiness
            + _points(named & ~c("has_empty_header"), 20)
            - F.least(F.lit(30.0), c("n_placeholders") / cells * 600)
            - _points(c("any_is_remark_dense"), 15)
        )
        format_score = F.when(
            c("n_nonempty_cells") > 0, F.greatest(F.lit(0.0), base_format * (1.0 - penalty))
        ).otherwise(base_format)
    else:
        readiness = readiness + _points(named, 20)
        format_score = base_format
    return sheet.select(
        "*",
        F.when(has_cells, c("n_valid_cells") / cells * 100).otherwise(0.0).alias("row_completeness"),
        F.when(has_cells, c("avg_valid") * 100).otherwise(0.0).alias("column_completeness"),
        format_score.cast("double").alias("format_consistency"),
        F.when(
            has_cells, round1(filled * F.greatest(F.lit(0.0), 1.0 - duplicate_ratio) * 100)
        ).otherwise(100.0).alias("duplicate_similar"),
        F.greatest(F.lit(0.0), structure).alias("table_structure"),
        F.when(has_cells, F.greatest(F.lit(0.0), readiness.cast("double")))
        .otherwise(0.0).alias("ai_query_readiness"),
    )


def scored(
    sheet: DataFrame, weights: dict[str, float] | None = None, mode: str = "readiness"
) -> DataFrame:
    total = total_score(weights or lx.DEFAULT_WEIGHTS, mode)
    return sheet.withColumn("total_score", total).withColumn("status", grade(F.col("total_score")))
