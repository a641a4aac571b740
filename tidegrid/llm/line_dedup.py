"""Line dedup with levelled sorted runs of line hashes.

The documents arrive in batches. The runs hold, per line key, the number of
documents seen and the largest doc_id holding it; a run is sorted by hash and
has each hash once. A batch first folds its own lines, then anti-joins them
against the merged runs: a key that already has enough documents and a larger
holder than any of the batch can no longer change and is left out. The rest
becomes a run of its own on level 0. When a level has ``fan_in`` runs they are
compacted by a merge into one run of the next level, so an entry is rewritten
once per level.

The key of a line is the line without ASCII white space at both ends and with
A-Z lower-cased; its hash is MD5 (128 bits), so keys are equal when hashes are.

Nulls and edges: null and empty texts are one empty line; rows with the same
``doc_id`` count as one document and a null ``doc_id`` as one below all others;
repeated lines of a document count once but are all dropped or kept together;
an empty table gives an empty result; further columns pass through, also those
that are named as the added ones.
"""

from __future__ import annotations

from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import batches_of_texts, fresh_names, id_text, materialize, text_of, with_fields

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FAN_IN = 4, 2
SPACE = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id inside the runs.
NO_ID = -(2**63)


def line_hashes(text: str, min_chars: int) -> list[bytes | None]:
    """Per line its key's hash, or nothing for a short key."""
    out: list[bytes | None] = []
    for line in text.encode().split(b"\n"):
        key = line.strip(SPACE).lower()
        if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
            out.append(None)
        else:
            out.append(md5(key).digest())
    return out


def distinct_lines(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """batch, doc_id, hash: each eligible key of a document once per row of the table."""

    def run(stream):
        for batch in stream:
            for part in batches_of_texts([batch]):
                ids, nos, hashes = [], [], []
                for i, no, text in zip(*(c.to_pylist() for c in part.columns)):
                    found = {h for h in line_hashes(text, min_chars) if h}
                    ids += [i] * len(found)
                    nos += [no] * len(found)
                    hashes += found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nos, pa.int32()), pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())],
                    ["batch", "doc_id", "hash"],
                )

    numbered = id_text(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        "text",
    ).select(
        # All rows of an id arrive in one batch, so that documents are counted once.
        "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "text")
    return numbered.mapInArrow(run, "batch int, doc_id long, hash binary")


def fold(runs: DataFrame) -> DataFrame:
    """Merge runs: one entry per hash, sorted within partitions."""
    return runs.groupBy("hash").agg(
        F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder")
    ).sortWithinPartitions("hash")


class LineRuns:
    """The levels; ``add`` takes one batch of (doc_id, hash) rows, distinct documents per batch."""

    def __init__(self, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN):
        self.min_docs, self.fan_in = min_docs, fan_in
        self.levels: list[list[DataFrame]] = []

    def all_runs(self) -> DataFrame | None:
        out = None
        for run in (r for level in self.levels for r in level):
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, lines: DataFrame) -> None:
        own = lines.groupBy("hash", "doc_id").count().groupBy("hash").agg(
            F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
        known = self.all_runs()
        if known is not None:
            settled = fold(known).filter(F.col("n_docs") >= self.min_docs).select(
                "hash", F.col("holder").alias("known_holder"))
            own = own.join(
                settled,
                (own["hash"] == settled["hash"]) & (settled["known_holder"] >= own["holder"]),
                "left_anti",
            )
        self._place(materialize(own.sortWithinPartitions("hash")), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)
            self.levels[level] = []
            self._place(materialize(fold(merged)), level + 1)

    def repeated(self) -> DataFrame:
        """hash, holder of the keys found in enough documents."""
        return fold(self.all_runs()).filter(F.col("n_docs") >= self.min_docs).select("hash", "holder")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with the deduplicated text, followed by the numbers of lines and of dropped lines.

    These last two columns are named n_lines and n_dropped, with underscores before where taken.
    """
    id_name, hashes_name, *added = fresh_names(docs, "line_id", "hashes", "n_lines", "n_dropped")
    lines = materialize(distinct_lines(docs, batches, min_chars))
    runs = LineRuns(min_docs, fan_in)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b).select("doc_id", "hash"))
    repeated = materialize(runs.repeated())
    dropped = (
        lines.join(repeated, "hash")  # a line that a third of the documents share is split by AQE
        .filter("doc_id != holder")
        .groupBy(F.col("doc_id").alias(id_name)).agg(F.collect_set("hash").alias(hashes_name))
    )
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    joined = docs.withColumn(id_name, own_id).withColumn("text", text_of()).join(dropped, id_name, "left").drop(id_name)
    schema = with_fields(docs, dict.fromkeys(added, "long"))
    names, at = docs.columns, docs.columns.index("text")

    def rebuild(stream):
        for batch in stream:
            for part in batches_of_texts([batch]):
                texts, n_lines, n_dropped = [], [], []
                for text, drop in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    n = text.count("\n") + 1
                    kept = n
                    if drop:
                        drop = set(drop)
                        stay = [x for x, h in zip(text.split("\n"), line_hashes(text, min_chars)) if h not in drop]
                        text, kept = "\n".join(stay), len(stay)
                    texts.append(text)
                    n_lines.append(n)
                    n_dropped.append(n - kept)
                columns = part.columns[:-1]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                    names=[*names, *added],
                )

    return joined.mapInArrow(rebuild, schema)
