"""Artifact fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import materialize
from tidegrid.sheet import Sheets


def _entry(position: Column, cell: Column) -> Column:
    """A cell with its position and length, so that no two rows read the same; blank cells leave no trace."""
    text = F.concat(position.cast("string"), F.lit("="), F.length(cell).cast("string"), F.lit(":"), cell)
    return F.when(F.coalesce(cell, F.lit("")) != "", text).otherwise("")


def row_digests(sheets: Sheets) -> DataFrame:
    """sheet_id, row_idx, digest: SHA-256 of the position and the row's cells; the header is row -1."""
    cells = [_entry(F.lit(i), c) for i, c in enumerate(sheets.cell_columns)]
    text = F.concat(F.col("row_idx").cast("string"), F.lit("|"), *cells)
    rows = sheets.rows.select("sheet_id", "row_idx", F.sha2(text, 256).alias("digest"))
    names = F.array_sort(F.collect_list(F.struct("col_idx", "name")))
    listed = F.array_join(F.transform(names, lambda x: _entry(x["col_idx"], x["name"])), "")
    header = sheets.headers.groupBy("sheet_id").agg(listed.alias("names")).select(
        "sheet_id", F.lit(-1).cast("long").alias("row_idx"),
        F.sha2(F.concat(F.lit("-1|"), F.col("names")), 256).alias("digest"),
    )
    return rows.unionByName(header)


def dataset_fingerprint(digests: DataFrame) -> DataFrame:
    """Order-free fingerprint per sheet: row count and sums of eight digest slices.

    Sums are associative, so the result does not depend on partitioning and
    combines map-side to one record per sheet and task.
    """
    def part(i: int):
        return F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")

    sums = digests.groupBy("sheet_id").agg(
        F.count_if(F.col("row_idx") >= 0).alias("n_rows"), *[F.sum(part(i)).alias(f"s{i}") for i in range(8)]
    )
    joined = F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(8)])
    return sums.select("sheet_id", "n_rows", F.sha2(joined, 256).alias("fingerprint"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, length, fingerprint of whole files."""
    return spark.read.format("binaryFile").load(path).select(
        "path", "length", F.sha2("content", 256).alias("fingerprint")
    )


def fallback_fingerprint(artifact_id: str):
    """Stands in for a raw artifact that is no longer there."""
    return F.sha2(F.concat(F.lit("raw:"), artifact_id), 256)


def verify(recomputed: DataFrame, recorded: DataFrame) -> DataFrame:
    """sheet_id, is_valid by recomputing and comparing."""
    known = recorded.select("sheet_id", F.col("fingerprint").alias("recorded"))
    return recomputed.join(known, "sheet_id", "full").select(
        "sheet_id", F.coalesce(F.col("fingerprint") == F.col("recorded"), F.lit(False)).alias("is_valid")
    )


#: Rows under a leaf of the hash tree, and children of an inner node.
LEAF_ROWS, FAN_OUT = 1024, 64


def hash_tree(digests: DataFrame, leaf_rows: int = LEAF_ROWS, fan_out: int = FAN_OUT) -> DataFrame:
    """sheet_id, level, node, digest: a Merkle tree over the row digests of every sheet.

    Level 0 hashes stretches of ``leaf_rows`` positions (the header is position 0), each further level
    ``fan_out`` nodes, up to one root (node 0 of the highest level) for the largest sheet. Only the
    leaves read the rows; a level is a ``fan_out``-th of the one below.
    """
    position = F.col("row_idx") + 1

    def joined(order: str, digest: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(order, digest)))
        return F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(x[order].cast("string"), F.lit(":"), x[digest])), ","), 256)

    level = materialize(digests.groupBy("sheet_id", F.floor(position / leaf_rows).alias("node")).agg(
        joined("row_idx", "digest").alias("digest")))
    tree, height = level.withColumn("level", F.lit(0)), 0
    while (level.agg(F.max("node")).first()[0] or 0) > 0:
        height += 1
        level = materialize(level.groupBy("sheet_id", F.floor(F.col("node") / fan_out).alias("parent")).agg(
            joined("node", "digest").alias("digest")).withColumnRenamed("parent", "node"))
        tree = tree.unionByName(level.withColumn("level", F.lit(height)))
    return tree.select("sheet_id", "level", "node", "digest")


def changed_stretches(before: DataFrame, after: DataFrame, leaf_rows: int = LEAF_ROWS, fan_out: int = FAN_OUT) -> DataFrame:
    """sheet_id, first_row, last_row of the leaves that differ between two trees, found by descending.

    Equal subtrees are not looked into. Row -1 is the header; a stretch that one tree lacks differs.
    """
    heights = [t.agg(F.max("level")).first()[0] or 0 for t in (before, after)]
    suspects = None
    for level in range(min(heights), -1, -1):
        b, a = (t.filter(F.col("level") == level).select("sheet_id", "node", F.col("digest").alias(n))
                for t, n in ((before, "b"), (after, "a")))
        if suspects is not None:
            # Joins under a shared parent: what is not below a suspect is equal on both sides.
            b, a = (t.withColumn("parent", F.floor(F.col("node") / fan_out)).join(
                suspects, ["sheet_id", "parent"], "left_semi").drop("parent") for t in (b, a))
        differing = b.join(a, ["sheet_id", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
        suspects = materialize(differing.select("sheet_id", F.col("node").alias("parent")))
    first = F.col("parent") * leaf_rows - 1
    return suspects.select("sheet_id", first.alias("first_row"), (first + leaf_rows - 1).alias("last_row"))
