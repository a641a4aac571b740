"""Stored assessment records: nested results to JSON text and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS_SCHEMA = "array<struct<name:string,completeness_ratio:double>>"
DETAILS_SCHEMA = (
    f"struct<columns:{COLUMNS_SCHEMA},row_distribution:struct<high:bigint,medium:bigint,low:bigint>,"
    "total_rows:bigint,filename:string>"
)


def to_record(result: DataFrame, filename: Column) -> DataFrame:
    """The ``result()`` of an assessment with its details as one JSON column."""
    details = F.struct(
        F.col("column_details").alias("columns"), "row_distribution", "total_rows",
        filename.alias("filename"),
    )
    return result.drop("column_details", "row_distribution", "total_rows").withColumn(
        "column_details", F.to_json(details)
    )


def parse_details(text: Column) -> Column:
    """Details of a record; older records hold only the array of columns."""
    is_array = F.startswith(F.ltrim(text), F.lit("["))
    old = F.struct(
        F.from_json(text, COLUMNS_SCHEMA).alias("columns"),
        F.lit(None).cast("struct<high:bigint,medium:bigint,low:bigint>").alias("row_distribution"),
        F.lit(None).cast("bigint").alias("total_rows"),
        F.lit(None).cast("string").alias("filename"),
    )
    return F.when(is_array, old).otherwise(F.from_json(text, DETAILS_SCHEMA))
