"""Rows that show a problem: one scan of the sheet to one narrow table of bit masks.

Every kind of problem (for some kinds every column of it) is a bit. Counts of
affected rows and the first rows to show come from the masks: hits are counted
per bucket of positions, the first few buckets of a bit hold its first rows, and
only those buckets are looked into. No row is sorted and no cell is carried
along; the cells of the rows to show are fetched by position.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import cells as fx
from tidegrid.operators import examples as ex
from tidegrid.operators.positions import first_rows
from tidegrid.session import materialize
from tidegrid.sheet import Sheets

#: Bits of one mask column, and positions of a bucket in which hits are counted.
MASK_BITS = 62
HIT_BUCKET_ROWS = 4096


@dataclass(frozen=True)
class Bit:
    """A problem of a row; ``item`` is the column of problems that are shown column by column."""

    kind: str
    hit: Column
    item: int = -1
    dominant: bool = False
    shown: bool = True


def _blank(i: int) -> Column:
    return F.col(f"__blank{i}")


def _format(i: int) -> Column:
    return F.col(f"__format{i}")


def cell_facts(sheets: Sheets, rows: DataFrame, formats: bool) -> DataFrame:
    """``rows`` with what several bits ask of a cell, so that it is evaluated once."""
    facts = {f"__blank{i}": fx.is_empty(c) for i, c in enumerate(sheets.cell_columns)}
    if formats:
        facts |= {f"__format{i}": fx.format_type(c) for i, c in enumerate(sheets.cell_columns)}
    return rows.withColumns(facts)


def problem_bits(sheets: Sheets, positions: dict[str, list[int]], formats: bool, subtotal: bool) -> list[Bit]:
    """Bits over the rows of ``cell_facts`` joined with the arrays of ``problem_columns`` and ``n_cols``."""
    cells = sheets.cell_columns

    def anywhere(kind: str, hit) -> Column:
        return fx.any_of([F.array_contains(kind, i) & hit(i) for i in positions[kind]])

    def filled(predicate):
        return lambda i: ~_blank(i) & predicate(cells[i])

    remark = filled(fx.has_inline_remark)
    every = range(sheets.width)
    bits = [
        Bit("empty", fx.any_of([(F.col("n_cols") > i) & _blank(i) for i in every])),
        Bit("lowfill", anywhere("lowfill", _blank)),
        Bit("placeholder", anywhere("placeholder", filled(fx.is_placeholder))),
        Bit("mismatch", anywhere("mismatch", filled(lambda c: ~fx.is_numeric_currency(c)))),
        Bit("newline", anywhere("newline", filled(fx.contains_newline))),
        *[Bit("remark", F.array_contains("remark", i) & remark(i), i) for i in positions["remark"]],
    ]
    text = fx.any_of([~_blank(i) & (_format(i) == "TEXT") for i in every]) if formats else F.lit(False)
    bits.append(Bit("text", text, shown=False))
    if formats:
        for i in positions["mixed"]:
            here = F.array_contains("mixed", i) & ~_blank(i)
            same = _format(i) == F.element_at("dominant", F.lit(i))
            bits += [Bit("format", here & same, i, True), Bit("format", here & ~same, i)]
    if subtotal:
        bits.append(Bit("subtotal", fx.any_of([filled(ex.has_subtotal_word)(i) for i in every])))
    return bits


def _mask(number: int) -> str:
    return f"mask{number // MASK_BITS}"


def hit_rows(sheets: Sheets, rows: DataFrame, bits: list[Bit], formats: bool, also: list[Column] = (),
             keep: Column | None = None) -> DataFrame:
    """sheet_id, row_idx, mask0.. and ``also``: rows with a bit set, and those that ``keep`` wants."""
    names = sorted({_mask(n) for n in range(len(bits))})
    masks = [
        reduce(lambda a, b: a + b, [
            F.when(bit.hit, F.lit(1 << n % MASK_BITS).cast("long")).otherwise(F.lit(0).cast("long"))
            for n, bit in enumerate(bits) if _mask(n) == name
        ]).alias(name)
        for name in names
    ]
    found = cell_facts(sheets, rows, formats).select("sheet_id", "row_idx", *masks, *also)
    hit = fx.any_of([F.col(name) != 0 for name in names])
    return found.filter(hit if keep is None else hit | keep)


def _is_set(number: int) -> Column:
    return F.getbit(F.col(_mask(number)), F.lit(number % MASK_BITS)) == 1


def _bucket(bucket_rows: int) -> Column:
    return F.floor(F.col("row_idx") / bucket_rows)


def hit_counts(hits: DataFrame, bits: list[Bit], bucket_rows: int = HIT_BUCKET_ROWS) -> DataFrame:
    """sheet_id, bucket, n0..: rows of a bucket with each bit."""
    return hits.groupBy("sheet_id", _bucket(bucket_rows).alias("bucket")).agg(
        *[F.count_if(_is_set(n)).alias(f"n{n}") for n in range(len(bits))])


def affected_rows(counts: DataFrame, bits: list[Bit]) -> DataFrame:
    """sheet_id, rows_<kind>: rows per sheet showing each problem that is one bit."""
    return counts.groupBy("sheet_id").agg(
        *[F.sum(f"n{n}").alias(f"rows_{bit.kind}") for n, bit in enumerate(bits) if bit.item < 0])


def first_hits(hits: DataFrame, counts: DataFrame, bits: list[Bit], limit: int,
               bucket_rows: int = HIT_BUCKET_ROWS) -> DataFrame:
    """First ``limit`` rows per sheet and kind: sheet_id, row_idx, kind, item, dominant, grp, ord, rank.

    Formats are listed per column and side, remarks column by column. A bucket
    that has a bit holds at least one row with it, so the first ``limit`` such
    buckets hold the first ``limit`` rows.
    """
    present = F.array_compact(F.array(*[
        F.when(F.col(f"n{n}") > 0, F.lit(n)) for n, bit in enumerate(bits) if bit.shown]))
    buckets = counts.select("sheet_id", "bucket", F.explode(present).alias("bit"))
    picked = materialize(first_rows(buckets, ["sheet_id", "bit"], ["bucket"], limit).drop("rank"))
    masks = F.array(*[F.col(c) for c in hits.columns if c.startswith("mask")])
    mask = F.get(masks, F.floor(F.col("bit") / MASK_BITS).cast("int"))
    rows = hits.withColumn("bucket", _bucket(bucket_rows)).join(picked, ["sheet_id", "bucket"]).filter(
        F.getbit(mask, F.col("bit") % MASK_BITS) == 1)

    def of(field: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(bit, field)) for bit in bits]), F.col("bit"))

    item = F.col("item")
    told = rows.select("sheet_id", "row_idx", of("kind").alias("kind"), of("item").alias("item"),
                       of("dominant").alias("dominant")).withColumns({
        "grp": F.when(F.col("kind") == "format", item).otherwise(-1),
        "ord": F.when(F.col("kind") == "remark", item).otherwise(-1)})
    return first_rows(told, ["sheet_id", "kind", "grp", "dominant"], ["ord", "row_idx"], limit)


def shown_rows(sheets: Sheets, first: DataFrame, at: DataFrame, layout: DataFrame,
               positions: dict[str, list[int]]) -> DataFrame:
    """``first_hits`` with the cells of their rows and the positions to highlight."""
    flags = ex.flagged_arrays(sheets, positions)
    flagged = F.array("item")
    for kind, found in flags.items():
        flagged = F.when(F.col("kind") == kind, found).otherwise(flagged)
    return first.join(at, ["sheet_id", "row_idx"]).join(layout.drop("dominant"), "sheet_id").select(
        *first.columns, F.array(*sheets.cell_columns).alias("cells"), flagged.alias("flagged"))
