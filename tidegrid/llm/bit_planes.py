"""Token-id files: bit or byte planes of fixed-size blocks, compressed with zstandard, with a chunk index.

Documents are dealt out by ranges of ``doc_id`` and sorted inside a range; a
range is one shard. A task encodes its documents one after the other and cuts
the stream of ids into blocks of ``BLOCK_IDS``. Of a block, plane ``p`` holds
bit ``p`` (or byte ``p``) of every id; each plane is compressed by itself. The
file has three Parquet tables, written by Spark's committer so that lost tasks
leave nothing behind:

* ``planes``: shard, block, plane, payload
* ``index``: shard, block, first_id, n_ids, n_bytes (the chunk index)
* ``documents``: shard, start (inside the shard), doc_id, n_tokens

Ids are unsigned 32-bit. Reading a document needs the blocks it lies in.

Nulls and edges: null and empty texts hold the end id alone; a null ``doc_id``
sorts first; rows with the same id follow by a hash of the text, so copies of
one id may lie in several shards, one after the other; an empty table gives
empty files; further columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import uuid
from array import array
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import batches_of_texts, per_worker, text_of
from tidegrid.session import shared_folder

BLOCK_IDS = 65_536
#: Bytes of text of one shard; their number follows from the table, not from a setting.
SHARD_BYTES = 32_000_000
LEVEL = 3
STORE_ENTRIES = 600_000
#: ASCII characters that are neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STREAM = "kind string, shard int, position long, block int, plane int, n long, value long, payload binary"


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Transpose ids into 32 bit planes or 4 byte planes, lowest first."""
    columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if unit == "byte":
        return [c.tobytes() for c in columns]
    empty = bytes((len(ids) + 7) // 8)
    return [
        np.packbits(column >> bit & 1, bitorder="little").tobytes() if column.any() else empty
        for column in map(np.ascontiguousarray, columns) for bit in range(8)
    ]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    """The ids of a block whose planes are given in order."""
    columns = np.zeros((4, n), np.uint8)
    for p, plane in enumerate(np.frombuffer(x, np.uint8) for x in planes):
        if unit == "byte":
            columns[p] = plane
        elif plane.any():
            columns[p // 8] |= np.unpackbits(plane, count=n, bitorder="little") << p % 8
    return np.ascontiguousarray(columns.T).view("<u4").reshape(-1)


class IdEncoder:
    """Ids of whole texts, by the library's encoder on the pieces between spaces and line ends.

    The tokenizer drops white space and never joins across it, so each distinct piece is encoded
    once. A piece of letters, perhaps with marks after it, is a word and a run of marks to the
    tokenizer; the words of a batch are encoded in one call, joined by spaces, and told apart by the
    token that ends a word.
    """

    def __init__(self, file_text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = json.loads(file_text)["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.store: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        pieces = {p for own in split for p in own}
        new = pieces.difference(self.store)
        if len(self.store) + len(new) > STORE_ENTRIES:
            self.store.clear()
            self.words.clear()
            new = pieces
        gc.disable()  # only strings and bytes are made here; nothing to collect
        try:
            self._learn(new)
        finally:
            gc.enable()
        return [b"".join(map(self.store.__getitem__, own)) for own in split]

    def _learn(self, pieces: set[str]) -> None:
        known, words, whole = self.words, {}, set()
        for piece in pieces:
            word = piece.rstrip(MARKS)
            if word.isascii():
                word = word.lower()
                simple = word.isalpha()
            else:
                simple = word.isalpha() and word.lower().isalpha()
            if simple:
                words[piece] = word
                if len(piece) > len(word):
                    whole.add(piece[len(word):])
            else:
                whole.add(piece)
        self._encode_words(list(set(words.values()).difference(known)), whole)
        listed = list(whole.difference(known))
        for piece, e in zip(listed, self.tokenizer.encode_batch_fast(listed, add_special_tokens=False)):
            known[piece] = array("I", e.ids).tobytes()
        for piece in whole:
            self.store[piece] = known[piece]
        for piece, word in words.items():
            marks = piece[len(word):]
            self.store[piece] = known[word] + known[marks] if marks else known[word]

    def _encode_words(self, words: list[str], whole: set[str]) -> None:
        """Encode words in one call; ``whole`` gets them if they do not come back one by one."""
        if not words:
            return
        joined = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(joined.ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(words):
            whole.update(words)
            return
        data, start = ids.tobytes(), 0
        for word, cut in zip(words, cuts):
            self.words[word] = data[start:cut]
            start = cut


@dataclass(frozen=True)
class IdFiles:
    """A written data set; ``folder`` holds the three tables."""

    folder: str
    unit: str

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        rows = spark.read.schema(STREAM).parquet(f"{self.folder}/stream").filter(F.col("kind") == kind)
        if kind == "planes":
            return rows.select("shard", "block", "plane", F.col("position").alias("first_id"),
                               F.col("n").alias("n_ids"), "payload")
        if kind == "index":
            return rows.select("shard", "block", F.col("position").alias("first_id"),
                               F.col("n").alias("n_ids"), F.col("value").alias("n_bytes"))
        return rows.select("shard", F.col("position").alias("start"), F.col("value").alias("doc_id"), F.col("n").alias("n_tokens"))


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, unit: str = "bit",
              block_ids: int = BLOCK_IDS, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> IdFiles:
    """Encode, append ``end_id`` to every document and write the file tables in ascending doc_id order."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tidegrid/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a fixed few MB
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(stream):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        text = shared.value
        encoder = per_worker("ids", text, lambda: IdEncoder(text))
        packer = zstandard.ZstdCompressor(level=LEVEL)
        shard = TaskContext.get().partitionId()
        waiting, held, block, position = [], 0, 0, 0

        def rows_of_block(data: bytes, block: int):
            n, payloads = len(data) // 4, []
            for plane, raw in enumerate(to_planes(np.frombuffer(data, dtype="<u4"), unit)):
                payloads.append(packer.compress(raw))
                yield ("planes", shard, block * block_ids, block, plane, n, None, payloads[-1])
            yield ("index", shard, block * block_ids, block, None, n, sum(map(len, payloads)), None)

        for batch in stream:
            for part in batches_of_texts([batch]):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids += end
                    rows.append(("documents", shard, position, None, None, len(ids) // 4, doc_id, None))
                    position += len(ids) // 4
                    waiting.append(ids)
                    held += len(ids)
                if held >= 4 * block_ids:
                    data = b"".join(waiting)
                    whole = len(data) - len(data) % (4 * block_ids)
                    for start in range(0, whole, 4 * block_ids):
                        rows += rows_of_block(data[start:start + 4 * block_ids], block)
                        block += 1
                    waiting, held = [data[whole:]], len(data) - whole
                yield _as_batch(rows)
        if held:
            yield _as_batch(list(rows_of_block(b"".join(waiting), block)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    placed = rows.withColumn("__h", F.xxhash64("text"))
    shards = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // shard_bytes)
    ordered = placed.repartitionByRange(max(shards, 1), F.col("doc_id").asc_nulls_first(), F.col("__h")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "__h").select("doc_id", "text")
    # The planes are compressed already.
    ordered.mapInArrow(run, STREAM).write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/stream")
    return IdFiles(folder, unit)


_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = ["kind", "shard", "position", "block", "plane", "n", "value", "payload"]


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def read_documents(spark: SparkSession, files: IdFiles, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start (over all shards), n_tokens, ids_crc32, decoded from the planes.

    ``wanted`` (doc_id) limits the result to some documents; the chunk index then tells which blocks
    hold them, and only the planes of those are read. Planes and document entries of a shard meet in one partition, sorted by position; a task holds
    one decoded block and the checksum of one open document.
    """
    unit, n_planes = files.unit, 32 if files.unit == "bit" else 4
    documents = files.table(spark, "documents")
    sizes = documents.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    shards = 1 + (sizes.agg(F.max("shard")).first()[0] or 0)
    planes_of = files.table(spark, "planes")
    if wanted is not None:
        documents = documents.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        index = files.table(spark, "index").select("shard", "block", "first_id", "n_ids")
        touched = documents.join(index, "shard").filter(
            "start < first_id + n_ids and start + n_tokens > first_id").select("shard", "block").distinct()
        planes_of = planes_of.join(touched, ["shard", "block"], "left_semi")

    def run(stream):
        unpacker, state = zstandard.ZstdDecompressor(), {"shard": None}

        def take(doc, block):
            """Feed the open document from the block at hand."""
            start, n, crc, done = doc[2], doc[3], doc[4], doc[5]
            first, ids = block
            lo = start + done - first
            piece = ids[max(lo, 0):max(lo, 0) + n - done]
            doc[4], doc[5] = crc32(piece.tobytes(), crc), done + len(piece)
            return doc[5] == n

        open_doc, block, planes = None, None, []
        for batch in stream:
            out = []
            for shard, position, kind, plane, n, doc_id, base, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != state["shard"]:
                    state["shard"], open_doc, block, planes = shard, None, None, []
                if kind == 0:
                    planes.append(unpacker.decompress(payload))
                    if len(planes) == n_planes:
                        block, planes = (position, from_planes(planes, n, unit)), []
                        if open_doc and take(open_doc, block):
                            out.append(open_doc)
                            open_doc = None
                else:
                    open_doc = [doc_id, base, position, n, 0, 0]
                    if take(open_doc, block):
                        out.append(open_doc)
                        open_doc = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in out], pa.int64()), pa.array([d[1] + d[2] for d in out], pa.int64()),
                 pa.array([d[3] for d in out], pa.int64()), pa.array([d[4] for d in out], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    nothing = F.lit(None)
    blocks = planes_of.select(
        "shard", F.col("first_id").alias("position"), F.lit(0).alias("kind"), "plane", F.col("n_ids").alias("n"),
        nothing.cast("long").alias("doc_id"), nothing.cast("long").alias("base"), "payload")
    entries = documents.join(bases, "shard").select(
        "shard", F.col("start").alias("position"), F.lit(1).alias("kind"), nothing.cast("int").alias("plane"),
        F.col("n_tokens").alias("n"), "doc_id", "base", nothing.cast("binary").alias("payload"))
    together = blocks.unionByName(entries).repartitionById(shards, "shard").sortWithinPartitions("shard", "position", "kind", "plane")
    return together.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
