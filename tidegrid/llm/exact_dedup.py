"""Exact dedup by a tree-merge of sorted digest runs.

Every partition hashes its texts and folds them into one sorted run of
``(digest, length, kept row, copies)``. In each round a node of the tree sends
the part of its run that starts with digest digit ``d`` to the node whose
address has ``d`` in that round's place, receives the matching parts of
``fan_in - 1`` others, merges them by digest and folds equal entries. After
the last round a node holds one complete stretch of the digest space. A text
that fills a third of the table is one entry per run from the first fold on,
and no node ever sees more than its stretch.

Equality is verified at every fold on the whole SHA-256 digest and the byte
length, not on the address digits or a short hash.

Nulls and edges: a null text counts as empty; a null ``doc_id`` ranks below
every other; of rows equal in text and id exactly one is kept; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import id_text, materialize

FAN_IN = 4
#: There are at least so many rounds that a node's stretch is expected to hold at most so many entries.
ENTRIES_PER_NODE = 4_000_000
RUN = "node int, digest binary, n_bytes long, keep_id long, keep_row long, copies long"


def _equal_to_previous(digests: pa.Array, lengths: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    plain = np.frombuffer(b"".join(digests.to_pylist()), dtype="V32")
    same = np.zeros(len(lengths), dtype=bool)
    same[1:] = (plain[1:] == plain[:-1]) & (lengths[1:] == lengths[:-1]) & (nodes[1:] == nodes[:-1])
    return same


def fold_runs(batches):
    """Fold equal neighbours of a sorted stream; the last row of a group is the one to keep."""
    held = None
    for batch in batches:
        table = pa.table({n: batch.column(n) for n in batch.schema.names})  # all fields nullable
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        lengths, nodes = (table[c].to_numpy() for c in ("n_bytes", "node"))
        same = _equal_to_previous(table["digest"].combine_chunks(), lengths, nodes)
        starts = np.flatnonzero(~same)
        last = np.append(starts[1:], table.num_rows) - 1
        copies = np.add.reduceat(table["copies"].to_numpy(), starts)
        folded = table.take(pa.array(last)).set_column(
            table.schema.get_field_index("copies"), "copies", pa.array(copies)
        )
        held = folded.slice(folded.num_rows - 1)
        yield from folded.slice(0, folded.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _sorted_run(df: DataFrame, largest: bool) -> DataFrame:
    """Each partition sorted so that the row to keep is the last of its group."""
    order = ["keep_id", "keep_row"]
    kept_last = [F.col(c).asc_nulls_first() if largest else F.col(c).desc_nulls_first() for c in order]
    return df.sortWithinPartitions("node", "digest", "n_bytes", *kept_last).mapInArrow(fold_runs, RUN)


def merge_runs(digests: DataFrame, largest: bool, rounds: int, fan_in: int = FAN_IN) -> DataFrame:
    """``digests`` (digest, n_bytes, doc_id, row_no) to one entry per distinct text."""
    nodes = fan_in**rounds
    leaves = digests.select(
        F.pmod(F.spark_partition_id(), F.lit(nodes)).cast("int").alias("node"), "digest", "n_bytes",
        F.col("doc_id").cast("long").alias("keep_id"), F.col("row_no").alias("keep_row"),
        F.lit(1).cast("long").alias("copies"),
    )
    runs = _sorted_run(leaves, largest)
    # The first four bytes of a digest give up to eight hexadecimal digits of address.
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    for r in range(rounds):
        place = fan_in**r
        digit = F.pmod(F.floor(head / F.lit(place)), F.lit(fan_in))
        own = F.pmod(F.floor(F.col("node") / F.lit(place)), F.lit(fan_in))
        target = (F.col("node") + (digit - own) * F.lit(place)).cast("int")
        exchanged = runs.withColumn("node", target).repartitionById(nodes, "node")  # one node a task
        runs = _sorted_run(exchanged, largest)
    return runs


def _rounds(leaves: int, rows: int, fan_in: int, entries_per_node: int) -> int:
    """Rounds until the tree has a node for every leaf partition, or more where stretches would be too long."""
    wanted, rounds = max(leaves, ceil(rows / entries_per_node)), 1
    while fan_in**rounds < wanted:
        rounds += 1
    return rounds


def exact_dedup(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN,
                entries_per_node: int = ENTRIES_PER_NODE) -> DataFrame:
    """doc_id, row_no, digest, keep_id, keep_row, group_size, kept: one row per row of ``docs``."""
    digests = materialize(
        id_text(docs).select(
            "doc_id", F.monotonically_increasing_id().alias("row_no"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.octet_length("text").cast("long").alias("n_bytes"),
        )
    )
    rounds = _rounds(digests.rdd.getNumPartitions(), digests.count(), fan_in, entries_per_node)
    groups = merge_runs(digests, keep == "largest", rounds, fan_in).filter("copies > 1")
    repeated = groups.select("digest", "n_bytes", "keep_id", "keep_row", "copies")
    joined = digests.join(repeated, ["digest", "n_bytes"], "left")  # AQE splits a hot digest
    alone = F.col("copies").isNull()
    return joined.select(
        "doc_id", "row_no", "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_row", "row_no").alias("keep_row"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row_no") == F.col("keep_row"))).alias("kept"),
    )
