"""CSV sources and sinks for sheets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.session import materialize
from tidegrid.sheet import Sheets, header_table
from tidegrid.sources.quotes import PIECES, SPLIT_EFFECTS, record_pieces, split_effects

MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_ROWS = 100_000
BOM = "﻿"


# A quoted cell's inside: a doubled quote is one quote, and a quote that neither a separator nor
# the end follows is text. Possessive, so no start is tried twice and long cells need no stack.
INSIDE = r'(?:[^"]++|""|"(?![",]|\z))*+'
CELL = rf'(?:"{INSIDE}"(?=,|\z)|(?!")[^,]*+)'
CLOSED = rf"\A{CELL}(?:,{CELL})*+\z"
RESUMED = rf'\A{INSIDE}"(?:,{CELL})*+\z'
CELLS = rf',("{INSIDE}"(?=,|\z)|"{INSIDE}\z|(?!")[^,]*+)'
SPLIT = ["file", "start"]
RECORD = ["row_idx", "file_no", "file_row"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the file split), value, blank, from_out, from_in; lines in the order of the file.

    The last two are the line's transition of the quote automaton: whether a quoted cell is open
    behind it (1) when none or one was open before it.
    """
    value = F.regexp_replace("value", r"\r\z", "")
    scan = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("value"))
    quoted = F.contains("value", F.lit('"'))
    return scan.select(
        "*", (F.col("value") == "").alias("blank"),
        F.when(quoted & ~F.col("value").rlike(CLOSED), 1).otherwise(0).alias("from_out"),
        F.when(quoted & F.col("value").rlike(RESUMED), 0).otherwise(1).alias("from_in"))


def _running(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with ``swaps`` and ``reset``: the transitions of all rows of a key up to each row, composed.

    A transition leaves the state, swaps it, or sets it whatever it was. Composed, these are the last
    setting (with the swaps seen by then) and the number of swaps.
    """
    upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sets, swap = F.col("from_out") == F.col("from_in"), F.col("from_out") > F.col("from_in")
    counted = df.withColumn("swaps", F.sum(F.when(swap, 1).otherwise(0)).over(upto))
    last = F.last(F.when(sets, F.struct(F.col("from_out").alias("state"), F.col("swaps").alias("at"))), ignorenulls=True)
    return counted.withColumn("reset", last.over(upto))


def _state(before: Column) -> Column:
    """The state after composed transitions that began in state ``before``."""
    free = (before + F.col("swaps")) % 2
    return F.when(F.col("reset").isNull(), free).otherwise(
        (F.col("reset.state") + F.col("swaps") - F.col("reset.at")) % 2)


def _places(effects: DataFrame) -> DataFrame:
    """file, start, entry (state at the split's start), records before it (offset, file_offset), file_no; one row per split."""
    along = W.partitionBy("file").orderBy("start")
    entered = _running(effects, ["file"], "start").select(
        *SPLIT, "n_out", "n_in", F.lag(_state(F.lit(0)), 1, 0).over(along).alias("entry"))
    counted = entered.withColumn("n", F.when(F.col("entry") == 0, F.col("n_out")).otherwise(F.col("n_in")))
    counted = counted.withColumn("in_file", F.sum("n").over(W.partitionBy("file"))).filter("in_file > 0")
    before = W.orderBy(*SPLIT).rowsBetween(W.unboundedPreceding, -1)
    return counted.select(
        *SPLIT, F.col("entry").cast("int"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("file_offset"),
        F.dense_rank().over(W.orderBy("file")).cast("long").alias("file_no"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """row_idx (over all files), file_no, file_row (position in its file), cells; files in path order.

    Quotes are lazy: one inside a cell that does not start with a quote is text. A file is cut into
    as many tasks as its size asks for, whatever is quoted in it. Empty lines outside of quotes are no records.

    Two scans, and no text is shuffled but that of records which cross the end of a split: the first finds what
    each split does to the state, composed over one small row per split; the second knows its state at the start.
    """
    lines = _lines(spark, path)
    effects = materialize(lines.drop("value").mapInArrow(split_effects, SPLIT_EFFECTS))
    # By broadcast, as the lines must keep their order; the table has one row per split.
    placed = lines.join(F.broadcast(materialize(_places(effects))), SPLIT)
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(CELLS), F.lit(1)), _unquoted)
    made = materialize(placed.mapInArrow(record_pieces, PIECES).select(
        *RECORD, "start", "part", F.when(F.col("part"), F.col("value")).alias("value"),
        F.when(~F.col("part"), cells).alias("cells")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), "\n")
    crossing = made.filter("part").groupBy(*RECORD).agg(text.alias("value")).select(*RECORD, cells.alias("cells"))
    return made.filter("not part").select(*RECORD, "cells").unionByName(materialize(crossing))


def _unquoted(cell: Column) -> Column:
    closed = cell.rlike(rf'\A"{INSIDE}"\z')
    inner = F.substring(cell, F.lit(2), F.length(cell) - F.when(closed, 2).otherwise(1))
    return F.when(F.startswith(cell, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(cell)


def widest(records: DataFrame) -> int:
    return records.agg(F.max(F.size("cells"))).first()[0] or 0


def read_records(spark: SparkSession, path: str, max_width: int | None = None) -> DataFrame:
    """row_idx plus c0..; ragged rows are padded with nulls, to the widest record unless a width is given."""
    records = csv_records(spark, path)
    width = max(widest(records), 1) if max_width is None else max_width
    return records.select("row_idx", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(width)])


def csv_metadata(spark: SparkSession, path: str) -> DataFrame:
    """sheet, row_count (header included), col_count; more than 100,001 records is an error flag."""
    return csv_records(spark, path).agg(
        F.lit("Sheet1").alias("sheet"), F.count("*").alias("row_count"),
        F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("col_count"),
        (F.count("*") > MAX_ROWS + 1).alias("too_many_rows"),
    )


def _sheet_of(records: DataFrame, rows: DataFrame, sheet_id: str, max_width: int | None) -> Sheets:
    """A sheet whose header is the first of ``records`` and whose data are ``rows`` (row_idx, cells)."""
    spark = records.sparkSession
    width = widest(records) if max_width is None else min(widest(records), max_width)
    head = records.filter("row_idx = 0").select("cells").first()
    names = ([c or "" for c in head.cells] + [""] * width)[:width] if head else []
    if names:
        names[0] = names[0].removeprefix(BOM)
    headers = header_table(spark, {sheet_id: names})
    rows = rows.select(
        F.lit(sheet_id).alias("sheet_id"), "row_idx",
        *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)],
    )
    if not width:
        return Sheets(
            rows.withColumn("c0", F.lit(None).cast("string")), headers, 1,
            empty=spark.createDataFrame([(sheet_id,)], "sheet_id string").coalesce(1),
        )
    return Sheets(rows, headers, width)


def read_csv_sheet(spark: SparkSession, path: str, sheet_id: str, max_width: int | None = None) -> Sheets:
    """Record 0 is the header, the rest is data; trailing blank rows are kept.

    A file without records is a sheet without columns; a folder is one sheet cut into files.
    """
    records = csv_records(spark, path)
    rows = records.filter("row_idx > 0").select((F.col("row_idx") - 1).alias("row_idx"), "cells")
    return _sheet_of(records, rows, sheet_id, max_width)


def read_csv_parts(spark: SparkSession, path: str, sheet_id: str) -> Sheets:
    """Read back what ``write_refined_csv`` wrote: part files in order, each with a header."""
    records = csv_records(spark, path)
    rows = records.filter("file_row > 0").select((F.col("row_idx") - F.col("file_no")).alias("row_idx"), "cells")
    return _sheet_of(records, rows, sheet_id, None)


@dataclass(frozen=True)
class UploadLimits:
    max_bytes: int = MAX_FILE_BYTES
    max_rows: int = MAX_ROWS


def validate_files(files: DataFrame, limits: UploadLimits = UploadLimits()) -> DataFrame:
    """Violations among (path, length, row_count, sheets, selected)."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = F.array_compact(F.array(
        F.when(~extension.isin("csv", "xlsx"), "unsupported_format"),
        F.when(F.col("length") > limits.max_bytes, "file_too_large"),
        F.when(F.col("row_count") > limits.max_rows, "too_many_rows"),
        F.when(F.col("selected").isNotNull() & ~F.array_contains("sheets", F.col("selected")),
               "sheet_not_found"),
    ))
    return files.select("path", F.explode(found).alias("violation"))


def select_sheet(files: DataFrame) -> DataFrame:
    """The selected sheet, or the only one."""
    only = F.when(F.size("sheets") == 1, F.get("sheets", F.lit(0)))
    return files.withColumn("selected", F.coalesce("selected", only))


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, length without reading contents."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def write_refined_csv(sheets: Sheets, path: str) -> None:
    """One sheet to CSV in row order: range-partitioned, sorted files, a header in each."""
    names = [r.name for r in sheets.headers.orderBy("col_idx").collect()]
    ordered = sheets.rows.orderBy("row_idx").select(
        *[F.coalesce(f"c{i}", F.lit("")).alias(f"c{i}") for i in range(sheets.width)]
    )
    # toDF keeps repeated or blank header names as they are.
    ordered.toDF(*names).write.option("emptyValue", "").csv(path, header=True, escape='"')


def write_sheets(sheets: Sheets, path: str) -> None:
    """Native sink: Parquet partitioned by sheet."""
    sheets.rows.write.partitionBy("sheet_id").parquet(f"{path}/rows")
    sheets.headers.write.parquet(f"{path}/headers")


def read_sheets(spark: SparkSession, path: str) -> Sheets:
    rows = spark.read.parquet(f"{path}/rows")
    width = sum(1 for c in rows.columns if c.startswith("c"))
    rows = rows.select("sheet_id", F.col("row_idx"), *[f"c{i}" for i in range(width)])
    return Sheets(rows, spark.read.parquet(f"{path}/headers"), width)


def preview(sheets: Sheets, n: int = 100) -> DataFrame:
    """The first rows as arrays with the sheet's counts."""
    counts = sheets.rows.groupBy("sheet_id").agg(F.count("*").alias("row_count"))
    top = sheets.rows.filter(F.col("row_idx") < n).select(
        "sheet_id", "row_idx", F.array(*sheets.cell_columns).alias("cells")
    )
    return top.join(counts, "sheet_id").join(
        sheets.shapes().select("sheet_id", F.col("n_cols").alias("col_count")), "sheet_id"
    )


def write_log(lines: DataFrame, path: str) -> None:
    """Readable log lines in entry order."""
    lines.orderBy("sheet_id", "seq", "item", "part").select("line").write.text(path)


