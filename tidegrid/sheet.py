"""The sheet model: string cells in a wide table keyed by ``(sheet_id, row_idx)``."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.cells import is_empty


@dataclass(frozen=True)
class Sheets:
    """One or many sheets.

    rows      sheet_id, row_idx, c0..cN (short rows hold nulls)
    headers   sheet_id, col_idx, name; one row per column of each sheet
    width     number of c columns in ``rows`` (the widest sheet)
    merged, comments, strikes, leading   optional annotation tables
    empty     optional: sheet_id of the sheets without any column
    """

    rows: DataFrame
    headers: DataFrame
    width: int
    merged: DataFrame | None = None
    comments: DataFrame | None = None
    strikes: DataFrame | None = None
    leading: DataFrame | None = None
    empty: DataFrame | None = None

    @property
    def cell_names(self) -> list[str]:
        return [f"c{i}" for i in range(self.width)]

    @property
    def cell_columns(self) -> list[Column]:
        return [F.col(c) for c in self.cell_names]

    @property
    def spark(self):
        return self.rows.sparkSession

    def with_rows(self, rows: DataFrame) -> "Sheets":
        return replace(self, rows=rows)

    def shapes(self) -> DataFrame:
        """sheet_id, n_cols, header_row_index."""
        shapes = self.headers.groupBy("sheet_id").agg(F.count("*").cast("int").alias("n_cols"))
        if self.empty is not None:
            shapes = shapes.unionByName(self.empty.select("sheet_id", F.lit(0).alias("n_cols")))
        if self.leading is None:
            return shapes.withColumn("header_row_index", F.lit(0))
        header = self.leading.groupBy("sheet_id").agg(
            F.max("row_no").cast("int").alias("header_row_index")
        )
        return shapes.join(header, "sheet_id", "left").na.fill(0, ["header_row_index"])

    def cells(self, only: list[int] | None = None) -> DataFrame:
        """Long view ``(sheet_id, row_idx, col_idx, raw)`` of the non-empty cells."""
        wanted = self.cell_names if only is None else [f"c{i}" for i in sorted(only)]
        index = F.substr(F.col("name"), F.lit(2)).cast("int")
        long = self.rows.unpivot(["sheet_id", "row_idx"], wanted, "name", "raw").select(
            "sheet_id", "row_idx", index.alias("col_idx"), "raw"
        )
        return long.filter(~is_empty(F.col("raw")))

    def cells_of(self, columns: DataFrame) -> DataFrame:
        """Non-empty cells of the ``(sheet_id, col_idx)`` pairs in ``columns``.

        Only the positions that occur in ``columns`` are read; there are at
        most ``width`` of them.
        """
        positions = [r.col_idx for r in columns.select("col_idx").distinct().collect()]
        if not positions:
            return self.cells([0]).filter(F.lit(False))
        return self.cells(positions).join(
            columns.select("sheet_id", "col_idx"), ["sheet_id", "col_idx"], "left_semi"
        )


def text_cell(df: DataFrame, name: str) -> Column:
    """Fixed text form of a typed column: decimals to two places, timestamps as dates."""
    kind = df.schema[name].dataType.typeName()
    c = F.col(name)
    if kind in ("double", "float") or kind.startswith("decimal"):
        return c.cast("decimal(18,2)").cast("string")
    if kind.startswith("timestamp"):
        return c.cast("date").cast("string")
    if kind in ("array", "map", "struct"):
        return F.to_json(c)
    return c.cast("string")


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores.

    A large input already has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sheets_from_table(
    df: DataFrame,
    sheet_id: str,
    columns: list[str],
    row_idx: str | Column,
    headers: list[str] | None = None,
) -> Sheets:
    """A typed table as one sheet; ``row_idx`` must be dense from 0."""
    index = F.col(row_idx) if isinstance(row_idx, str) else row_idx
    rows = spread(df.select(*columns, index.alias("__row_idx"))).select(
        F.lit(sheet_id).alias("sheet_id"),
        F.col("__row_idx").cast("long").alias("row_idx"),
        *[text_cell(df, c).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    return Sheets(rows, header_table(df.sparkSession, {sheet_id: headers or columns}), len(columns))


def header_table(spark, names: dict[str, list[str]]) -> DataFrame:
    """Header rows as a local relation, so the planner knows they are small."""
    entries = [(s, i, n) for s, hs in names.items() for i, n in enumerate(hs)]
    sheet_ids, positions, texts = zip(*entries) if entries else ((), (), ())
    table = pa.table({
        "sheet_id": pa.array(sheet_ids, pa.string()),
        "col_idx": pa.array(positions, pa.int32()),
        "name": pa.array(texts, pa.string()),
    })
    return spark.createDataFrame(table)


def union_sheets(parts: list[Sheets]) -> Sheets:
    """Many sheets in one table, so one job serves them all."""
    width = max(p.width for p in parts)

    def padded(p: Sheets) -> DataFrame:
        extra = [F.lit(None).cast("string").alias(f"c{i}") for i in range(p.width, width)]
        return p.rows.select("sheet_id", "row_idx", *p.cell_names, *extra)

    def joined(field: str) -> DataFrame | None:
        tables = [getattr(p, field) for p in parts if getattr(p, field) is not None]
        out = None
        for t in tables:
            out = t if out is None else out.unionByName(t)
        return out

    rows = padded(parts[0])
    for p in parts[1:]:
        rows = rows.unionByName(padded(p))
    return Sheets(
        rows, joined("headers"), width,
        joined("merged"), joined("comments"), joined("strikes"), joined("leading"), joined("empty"),
    )
