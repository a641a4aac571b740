"""Entity-name variants: spellings that differ only by company suffix or case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import cells as fx
from tidegrid.sheet import Sheets


def spellings(sheets: Sheets, columns: DataFrame, join_lines: bool = True) -> DataFrame:
    """sheet_id, col_idx, key, spelling, n, first_row; one row per distinct spelling."""
    spelling = fx.trim_ws(F.col("raw"))
    if join_lines:
        spelling = F.replace(spelling, F.lit("\n"), F.lit(" "))
    counted = (
        sheets.cells_of(columns)
        .groupBy("sheet_id", "col_idx", spelling.alias("spelling"))
        .agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"))
    )
    return counted.withColumn("key", fx.entity_key(F.col("spelling")))


def variant_groups(named: DataFrame) -> DataFrame:
    """Keys with more than one spelling, with the most frequent (then first seen) one."""
    rank = F.struct(F.col("n"), -F.col("first_row"))
    return (
        named.groupBy("sheet_id", "col_idx", "key")
        .agg(
            F.count("*").alias("n_variants"),
            F.max("n").alias("canonical_count"),
            F.max_by("spelling", rank).alias("canonical"),
            F.sum("n").alias("total_rows"),
            F.min("first_row").alias("first_row"),
        )
        .filter(F.col("n_variants") > 1)
    )


def canonical_mapping(named: DataFrame, groups: DataFrame) -> DataFrame:
    """sheet_id, col_idx, spelling, canonical for the spellings to replace."""
    return (
        named.join(groups.select("sheet_id", "col_idx", "key", "canonical"),
                   ["sheet_id", "col_idx", "key"])
        .filter(F.col("spelling") != F.col("canonical"))
        .select("sheet_id", "col_idx", "spelling", "canonical")
    )
