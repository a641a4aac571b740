"""Report tables and the readable audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.operators.positions import BUCKET_ROWS, first_rows

REPORT_ISSUES = 20
REPORT_DESCRIPTION = 80
LOG_LINE_ROWS = 10_000


def indicator_table(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """sheet_id, pos, name, score, weight as printed text."""
    weights = weights or lx.DEFAULT_WEIGHTS
    entries = [
        F.struct(
            F.lit(i).alias("pos"), F.lit(lx.INDICATOR_LABELS[k]).alias("name"),
            F.format_string("%.1f", F.col(k)).alias("score"),
            F.format_string("%.0f%%", F.lit(weights[k] * 100)).alias("weight"),
        )
        for i, k in enumerate(lx.INDICATORS)
    ]
    return scores.select("sheet_id", F.inline(F.array(*entries)))


def issue_table(issues: DataFrame) -> DataFrame:
    """The first 20 issues with descriptions cut to 80 characters."""
    text = F.col("description")
    cut = F.when(
        F.length(text) > REPORT_DESCRIPTION,
        F.concat(F.left(text, F.lit(REPORT_DESCRIPTION - 3)), F.lit("...")),
    ).otherwise(text)
    top = first_rows(issues, ["sheet_id"], ["pos"], REPORT_ISSUES).drop("rank")
    return top.select("sheet_id", "pos", "severity", cut.alias("description"))


def before_after_table(sessions: DataFrame) -> DataFrame:
    """From (sheet_id, rows_before, rows_after, score_before, score_after)."""
    return sessions.select("sheet_id", F.inline(F.array(
        F.struct(F.lit("資料列數").alias("measure"), F.col("rows_before").cast("string").alias("before"),
                 F.col("rows_after").cast("string").alias("after")),
        F.struct(F.lit("評分").alias("measure"), F.format_string("%.1f", "score_before").alias("before"),
                 F.format_string("%.1f", "score_after").alias("after")),
    )))


def rule_table(spark, rules: list[str]) -> DataFrame:
    lines = [f"{i}. {lx.RULE_LABELS.get(r, r)}" for i, r in enumerate(rules, 1)]
    return spark.createDataFrame(
        [(i, t) for i, t in enumerate(lines or ["未套用任何規則"], 1)], "pos int, line string"
    )


def log_lines(log: DataFrame, ts, rows_per_line: int = LOG_LINE_ROWS) -> DataFrame:
    """Readable log: ``[ts] label：第 r1, r2 列 — details``.

    An entry prints on one line up to ``rows_per_line`` rows, wherever they are;
    a longer one continues on further lines, so no array is unbounded. Rows are
    counted inside buckets of positions, plus one row per bucket.
    """
    from tidegrid.operators.cleaning import audit_entries

    keys = ["seq", "sheet_id", "operation_type", "item"]
    bucketed = log.withColumn("__bucket", F.coalesce(F.floor(F.col("row_idx") / BUCKET_ROWS), F.lit(-1)))
    inside = W.partitionBy(*keys, "__bucket").orderBy("row_idx")
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = bucketed.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n")).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
    )
    at = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__bucket") == F.col("__b")]
    ranked = bucketed.withColumn("__pos", F.row_number().over(inside) - 1).join(offsets, at)
    numbered = ranked.withColumn("part", F.floor((F.col("__offset") + F.col("__pos")) / rows_per_line))
    chunks = numbered.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list("row_idx")).alias("rows")
    )
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    label = F.create_map(*[F.lit(x) for kv in lx.OPERATION_LABELS.items() for x in kv])
    op = F.col("e.operation_type")
    listed = F.when(F.size("rows") > 0, F.concat(
        F.lit("：第 "), F.array_join(F.col("rows").cast("array<string>"), ", "), F.lit(" 列")
    )).otherwise("")
    details = F.col("e.details")
    tail = F.when(details != "", F.concat(F.lit(" — "), details)).otherwise("")
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    line = F.concat(
        F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "),
        F.coalesce(F.try_element_at(label, op), op), listed, tail,
    )
    return chunks.alias("c").join(audit_entries(log).alias("e"), condition).select(
        *[F.col(f"e.{k}") for k in keys], F.col("c.part"), line.alias("line")
    )
