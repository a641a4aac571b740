"""Delta-maintained token-count rollups.

A batch is a table of changes: ``insert`` and ``delete`` carry a count,
``revise`` the count it replaces and the new one. Signed, they add up per
source, language and tokenizer version to one small delta, which is written
under the batch's name; then one row in the log of commits makes it count.
Totals are the sum of the committed deltas and never look at documents again.

A batch commits once: replaying a name that is in the log does nothing when its
changes are the same and is an error when they differ (told by an
order-independent checksum of the changes). A writer that dies before its log
row leaves a delta that no reader uses and the next attempt overwrites.

Nulls and edges: a null source, language or version is a group of its own; a
null count is zero; an unknown operation is an error; repeated rows count
each time; an empty batch commits an empty delta; groups whose counts are all
zero disappear; further columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.bpe import _shared_file, worker_bpe
from tidegrid.llm.common import batches_of_texts, id_text, with_fields
from tidegrid.session import shared_folder

KEYS = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
LOG = "batch string, checksum long, n_changes long"


def signed(changes: DataFrame) -> DataFrame:
    """KEYS, n_docs and n_tokens with the sign of each change."""
    op, new = F.col("op"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long"))
    old = F.coalesce(F.col("old_n_tokens").cast("long"), F.lit(0).cast("long"))
    known = F.when(op.isin("insert", "delete", "revise"), op).otherwise(
        F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("null")))))
    return changes.select(
        *[F.col(k).cast("string").alias(k) for k in KEYS],
        F.when(known == "insert", 1).when(known == "delete", -1).otherwise(0).cast("long").alias("n_docs"),
        F.when(op == "insert", new).when(op == "delete", -new).otherwise(new - old).alias("n_tokens"),
    )


class TokenRollup:
    """Rollup kept in ``folder``, by default a new one in the shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/tidegrid/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        # A first row without a name, so that the log can always be read.
        self._append_log("", 0, 0, "ignore")

    def _append_log(self, batch: str, checksum: int, n: int, mode: str = "append") -> None:
        row = self.spark.createDataFrame([(batch, checksum, n)], LOG).coalesce(1)
        row.write.mode(mode).parquet(f"{self.folder}/log")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log").filter("batch <> ''")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False when it had been committed before."""
        parts = changes.select(
            *KEYS, "op", "doc_id", F.col("n_tokens").cast("long"), F.col("old_n_tokens").cast("long"))
        # A wrapping sum of row hashes does not depend on the order of the rows.
        told = parts.agg(
            F.coalesce(F.sum(F.xxhash64(*parts.columns).cast("decimal(38,0)")), F.lit(0)).alias("s"),
            F.count("*").alias("n")).select(F.xxhash64("s", "n").alias("checksum"), "n").first()
        found = self.log().filter(F.col("batch") == batch).first()
        if found:
            if found.checksum != told.checksum:
                raise ValueError(f"batch {batch} was committed with other changes")
            return False
        delta = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.folder}/deltas/name={_folder_name(batch)}")
        self._append_log(batch, told.checksum, told.n)
        return True

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens over all committed batches."""
        names = self.log().select(F.col("batch")).distinct()
        if names.isEmpty():
            return self.spark.createDataFrame([], DELTA)
        deltas = self.spark.read.schema(DELTA + ", name string").parquet(f"{self.folder}/deltas")
        committed = names.select(F.hex("batch").alias("name"))
        return deltas.join(committed, "name", "left_semi").groupBy(*KEYS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
        ).filter("n_docs <> 0 or n_tokens <> 0")


def _folder_name(batch: str) -> str:
    return batch.encode().hex().upper()


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, source, lang, n_bytes, n_tokens of every row, by the byte-level BPE encoder."""
    shared = _shared_file(docs, tokenizer_path)

    def run(stream):
        bpe = worker_bpe(shared.value)
        for batch in stream:
            for part in batches_of_texts([batch]):
                texts = part.column(3).to_pylist()
                counts = [ids.count(",") + 1 if ids else 0 for ids in bpe.encode_batch(texts)]
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                    ["doc_id", "source", "lang", "n_bytes", "n_tokens"])

    rows = id_text(docs, "source", "lang").select("doc_id", "source", "lang", "text")
    return rows.mapInArrow(run, with_fields(rows.drop("text"), n_bytes="long", n_tokens="long"))
