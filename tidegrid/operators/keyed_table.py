"""Tables with a key that are changed in place: an upsert rewrites the buckets of the changed keys only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.usage import upsert
from tidegrid.session import materialize

BUCKET = "key_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Parquet in one folder per hash bucket of the key; the number of buckets is fixed when written."""

    spark: SparkSession
    folder: str
    keys: list[str]
    buckets: int

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _write(self, rows: DataFrame) -> None:
        # Rows of a bucket meet in one task, so that a bucket is few files.
        rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            BUCKET).parquet(self.folder)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.folder).drop(BUCKET)

    def write(self, rows: DataFrame) -> None:
        self._write(rows.select("*", self._bucket()))

    def upsert(self, changes: DataFrame, order: str) -> list[int]:
        """Insert or update by key, the latest of ``order`` wins; returns the buckets rewritten.

        The merged buckets are written aside before they replace the old ones, so a job that fails
        half-way leaves the old rows, and a batch that is tried again changes nothing.
        """
        placed = materialize(changes.select("*", self._bucket()))
        touched = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())
        if touched:
            current = self.spark.read.parquet(self.folder)
            held = current.filter(F.col(BUCKET).isin(touched)).select(*placed.columns)
            self._write(materialize(upsert(held, placed, [BUCKET, *self.keys], order)))
        return touched


def keyed_table(rows: DataFrame, folder: str, keys: list[str], buckets: int = 256) -> KeyedTable:
    """Write ``rows`` (one per key) as a keyed table."""
    table = KeyedTable(rows.sparkSession, folder, keys, buckets)
    table.write(rows)
    return table
