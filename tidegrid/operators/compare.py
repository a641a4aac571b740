"""Before/after comparison, issue differences, rule recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid import lexicon as lx


def signed(delta: Column) -> Column:
    sign = F.when(delta >= 0, "+").otherwise("")
    return F.concat(sign, F.format_string("%.1f", delta))


def score_label(before: Column, after: Column) -> Column:
    return F.concat(F.format_string("%.1f (", before), signed(after - before), F.lit(")"))


def indicator_label(before: Column, after: Column) -> Column:
    return F.concat(
        F.format_string("%.1f → %.1f (", before, after), signed(after - before), F.lit(")")
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Join two score tables by sheet; one row per sheet and measure.

    A sheet that only one table has is listed with a null score and no label.
    """
    measures = [*lx.INDICATORS, "total_score"]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot(["sheet_id"], measures, "measure", name)

    b, a = F.col("before"), F.col("after")
    label = F.when(F.col("measure") == "total_score", score_label(b, a)).otherwise(
        indicator_label(b, a)
    )
    return long(before, "before").join(long(after, "after"), ["sheet_id", "measure"], "full").select(
        "sheet_id", "measure", "before", "after", label.alias("label")
    )


def resolved_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues whose title no longer occurs; the remaining ones are ``after`` itself."""
    return before.join(after.select("sheet_id", "title"), ["sheet_id", "title"], "left_anti")


def recommend_rules(issues: DataFrame) -> DataFrame:
    """sheet_id, rule: cleaning rules that apply to a sheet's issue list, in menu order."""
    c = F.col

    def has_indicator(name: str) -> Column:
        return F.max(c("indicator") == name)

    def mentions(word: str) -> Column:
        return F.max(F.contains(c("description"), F.lit(word)))

    complete, tables = has_indicator("completeness"), mentions("多表格")
    rules = {
        "date_normalize": F.lit(True),
        "dedup": has_indicator("duplicate_similar"),
        "name_normalize": has_indicator("name_variants"),
        "subtotal_remove": mentions("小計"),
        "newline_remove": mentions("換行"),
        "bracket_note_remove": mentions("備註"),
        "empty_row_remove": tables | complete,
        "multi_table_keep_main": tables,
        "empty_col_remove": complete | mentions("缺漏"),
    }
    flags = issues.groupBy("sheet_id").agg(*[cond.alias(r) for r, cond in rules.items()])
    listed = F.array_compact(F.array(*[F.when(c(r), F.lit(r)) for r in rules]))
    return flags.select("sheet_id", F.posexplode(listed).alias("pos", "rule"))
