"""Stored access paths: trigram posting lists for text search, rank directories for deep pages."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.operators.usage import DEFAULT_PAGE_SIZE, page_bounds
from tidegrid.session import materialize, shared_folder

GRAM = 3
#: Lists that are intersected at most; the text itself decides in the end.
LISTS = 3
RANGE_ROWS = 100_000


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, ignoring case; none for a shorter one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(
        F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))


@dataclass(frozen=True)
class TrigramIndex:
    """entries: the rows, numbered; lists: (gram, no), sorted by gram; counts: rows per gram."""

    entries: DataFrame
    lists: DataFrame
    counts: DataFrame
    columns: list[str]


def trigram_index(entries: DataFrame, columns: list[str]) -> TrigramIndex:
    """Posting lists over the given text columns.

    The lists are range-partitioned and sorted by gram, so that a search reads the row groups of its
    grams only; a gram that most rows hold is cut over several files.
    """
    numbered = materialize(entries.withColumn("no", F.monotonically_increasing_id()))
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in columns])))
    lists = numbered.select(F.explode(every).alias("gram"), "no").repartitionByRange("gram", "no")
    lists = materialize(lists.sortWithinPartitions("gram", "no"))
    counts = materialize(lists.groupBy("gram").agg(F.count("*").alias("n")))
    return TrigramIndex(numbered, lists, counts, columns)


def _contains(columns: list[str], query: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).ilike(f"%{query}%")
    return F.coalesce(found, F.lit(False))


def search_text(index: TrigramIndex, query: str) -> DataFrame:
    """Rows of which a column contains the query, ignoring case; as ``search_translations`` finds them.

    The rarest grams of the query give the candidates, which the text confirms. Queries of fewer than
    three characters, or with pattern characters, read all rows.
    """
    low = query.lower()
    if len(low) < GRAM or any(c in low for c in "%_\\"):
        return index.entries.filter(_contains(index.columns, query)).drop("no")
    wanted = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    sizes = {r.gram: r.n for r in index.counts.filter(F.col("gram").isin(wanted)).collect()}
    rarest = sorted(wanted, key=lambda g: (sizes.get(g, 0), g))[:LISTS]
    hits = index.lists.filter(F.col("gram").isin(rarest)).groupBy("no").count().filter(F.col("count") == len(rarest))
    found = index.entries.join(hits.select("no"), "no", "left_semi")
    return found.filter(_contains(index.columns, query)).drop("no")


@dataclass(frozen=True)
class RankDirectory:
    """Rows written in ranges of their order, with the rank at which each range begins."""

    rows: DataFrame
    ranges: DataFrame
    order: list[str]

    def _order(self) -> list[Column]:
        return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in self.order]

    def page(self, page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
        """The rows of ``offset`` and ``limit`` over the whole order, read from the ranges that hold them."""
        offset, limit = page_bounds(page, size)
        held = self.ranges.filter((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))
        found = {r.part: r.start for r in held.collect()}
        if not found:
            return self.rows.limit(0).drop("part")
        picked = self.rows.filter(F.col("part").isin(sorted(found))).orderBy(*self._order())
        return picked.offset(offset - min(found.values())).limit(limit).drop("part")


def rank_directory(df: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> RankDirectory:
    """``order``: column names, with ``-`` before descending ones, that together tell rows apart.

    One range partitioning and one folder per range; the directory has one row per range.
    """
    spark = df.sparkSession
    columns = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    parts = max(ceil(df.count() / range_rows), 1)
    path = f"{shared_folder(spark)}/tidegrid/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    placed = df.repartitionByRange(parts, *columns).withColumn("part", F.spark_partition_id())
    placed.write.partitionBy("part").parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    ranges = materialize(rows.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    return RankDirectory(rows, ranges, order)
