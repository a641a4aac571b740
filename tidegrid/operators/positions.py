"""Row positions without global sorts or single-task windows.

All schemes are two-level: work inside buckets of consecutive positions, plus
one summary row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.session import materialize

BUCKET_ROWS = 65_536
#: Positions of one bitmap, as Spark's bitmap functions make them.
BITMAP_ROWS = 32_768


def _rows_before(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Prefix sums over one row per file or file split, written so joins can broadcast them."""
    before = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    return materialize(
        sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    )


def number_parquet_rows(scan: DataFrame) -> DataFrame:
    """Dense ``row_idx`` in file order for a fresh Parquet scan.

    The reader knows each row's position in its file, so only the rows of the
    files before it are added.
    """
    tagged = scan.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )
    offsets = _rows_before(tagged.groupBy("__file").agg(F.count("*").alias("__n")), ["__file"])
    return tagged.join(offsets, "__file").select(
        *scan.columns, (F.col("__offset") + F.col("__row")).alias("row_idx")
    )


def number_rows(scan: DataFrame) -> DataFrame:
    """Dense ``row_idx`` in file order for any fresh file scan.

    Rows of one file split are contiguous and ordered: a row's position is its
    offset in the split plus the rows of the splits before it. The tagged scan
    is written first, because a second scan may be split differently.
    """
    tagged = materialize(scan.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    ))
    splits = tagged.groupBy("__file", "__start").agg(
        F.count("*").alias("__n"), F.min("__id").alias("__first")
    )
    offsets = _rows_before(splits, ["__file", "__start"])
    return tagged.join(offsets, ["__file", "__start"]).select(
        *scan.columns, (F.col("__offset") + F.col("__id") - F.col("__first")).alias("row_idx")
    )


def _bucketed(df: DataFrame, position: str, bucket_rows: int) -> DataFrame:
    return df.withColumn("__bucket", F.floor(F.col(position) / bucket_rows))


def _offsets(per_bucket: DataFrame, value: str) -> DataFrame:
    before = W.partitionBy("sheet_id").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    return per_bucket.select(
        "sheet_id", "__bucket", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("__offset")
    )


def alive_ranks(rows: DataFrame, bucket_rows: int = BITMAP_ROWS) -> DataFrame:
    """sheet_id, __bucket, __bitmap, __offset: which positions of a bucket have a row, and the rows before it.

    A bucket of 32,768 positions is one bitmap of 4 KB, built with map-side combine.
    """
    bits = _bucketed(rows.select("sheet_id", "row_idx"), "row_idx", bucket_rows)
    maps = materialize(bits.groupBy("sheet_id", "__bucket").agg(
        F.bitmap_construct_agg((F.col("row_idx") % bucket_rows).cast("long")).alias("__bitmap"),
        F.count("*").alias("__n")))
    return maps.drop("__n").join(_offsets(maps, "__n"), ["sheet_id", "__bucket"])


def ranked(df: DataFrame, ranks: DataFrame, bucket_rows: int = BITMAP_ROWS) -> DataFrame:
    """``row_idx`` replaced by its rank among the rows of ``ranks``; a null stays null."""
    at = F.col("row_idx") % bucket_rows
    whole = F.bitmap_count(F.substring("__bitmap", F.lit(1), F.floor(at / 8).cast("int")))
    byte = F.conv(F.hex(F.substring("__bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    below = F.call_function("shiftleft", F.lit(1), (at % 8).cast("int")) - 1
    rest = F.bit_count(byte.bitwiseAND(below))
    rank = (F.col("__offset") + whole + rest).cast("long")
    return _bucketed(df, "row_idx", bucket_rows).join(ranks, ["sheet_id", "__bucket"], "left").withColumn(
        "row_idx", F.when(F.col("row_idx").isNotNull(), rank)).select(*df.columns)


def reindex(rows: DataFrame, bucket_rows: int = BITMAP_ROWS) -> DataFrame:
    """Make ``row_idx`` dense again, keeping the order; no rows are sorted."""
    return ranked(rows, alive_ranks(rows, bucket_rows), bucket_rows)


def runs(df: DataFrame, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """keys, first, last: the runs of consecutive ``row_idx`` of a key, each position once.

    Runs are found inside buckets; those that touch a border of their bucket, at most two a bucket, are
    then stitched together.
    """
    bucketed = _bucketed(df.filter(F.col("row_idx").isNotNull()).select(*keys, "row_idx"), "row_idx", bucket_rows)
    inside = W.partitionBy(*keys, "__bucket").orderBy("row_idx")
    found = bucketed.withColumn("__island", F.col("row_idx") - F.dense_rank().over(inside)).groupBy(
        *keys, "__bucket", "__island").agg(F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))
    found = materialize(found.drop("__island"))
    edge = (F.col("first") % bucket_rows == 0) | (F.col("last") % bucket_rows == bucket_rows - 1)
    along = W.partitionBy(*keys).orderBy("first")
    starts = F.coalesce(F.col("first") != F.lag("last").over(along) + 1, F.lit(True))
    border = found.filter(edge).withColumn("__starts", F.when(starts, 1).otherwise(0)).withColumn(
        "__no", F.sum("__starts").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    stitched = border.groupBy(*keys, "__no").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return found.filter(~edge).select(*keys, "first", "last").unionByName(stitched.drop("__no"))


def prefix_sum(
    df: DataFrame, value: str, position: str, out: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Running sum of ``value`` per sheet in ``position`` order, inclusive."""
    bucketed = _bucketed(df, position, bucket_rows)
    totals = bucketed.groupBy("sheet_id", "__bucket").agg(F.sum(value).alias("__n"))
    inside = W.partitionBy("sheet_id", "__bucket").orderBy(position)
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        bucketed.withColumn("__inner", F.sum(value).over(inside))
        .join(_offsets(totals, "__n"), ["sheet_id", "__bucket"])
        .withColumn(out, F.col("__offset") + F.col("__inner"))
        .select(*df.columns, out)
    )


def next_position(
    df: DataFrame, position: str, out: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The following ``position`` of the same sheet (null for the last row)."""
    bucketed = _bucketed(df, position, bucket_rows)
    firsts = bucketed.groupBy("sheet_id", "__bucket").agg(F.min(position).alias("__min"))
    following = firsts.select(
        "sheet_id", "__bucket",
        F.lead("__min").over(W.partitionBy("sheet_id").orderBy("__bucket")).alias("__next_min"),
    )
    inside = W.partitionBy("sheet_id", "__bucket").orderBy(position)
    return (
        bucketed.withColumn("__lead", F.lead(position).over(inside))
        .join(following, ["sheet_id", "__bucket"])
        .withColumn(out, F.coalesce("__lead", "__next_min"))
        .select(*df.columns, out)
    )


def first_rows(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows per key; the row-number filter is applied before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
