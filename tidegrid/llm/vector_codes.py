"""Product codes of vectors in integers, by sequency-ordered Walsh-Hadamard transforms.

Components become ``floor(scale * x)``, vectors are cut into equal parts, and
every part position has a codebook. Parts and entries are padded with zeros to
a power of two and transformed by the integer Walsh-Hadamard transform, which
multiplies squared distances by the padded length. Squared differences are then
added coefficient by coefficient in sequency order (fewest sign changes first,
where most of a part's energy lies): a partial sum is a lower bound, so an
entry leaves as soon as it is above the distance of the entry that starts best.
All arithmetic is in 64-bit integers.

A round is one pass over the vectors: tasks send counts and sums by part and
entry, which Spark adds; only codebooks (parts x entries, whatever the table's
size) reach the driver and travel to the tasks.

Nulls and edges: vectors that are null or hold null, NaN or infinite components
are dropped. The length of the smallest kept ``vec_id``'s vector, if positive
and a multiple of the number of parts, is the table's; vectors of another
length, and those with a component so large that a scaled distance would not
fit 64 bits (``|floor(scale * x)| >= 2**30 / padded length``), stay with null
code and error and take no part in the codebooks. A null ``vec_id`` ranks last;
rows that repeat a ``vec_id`` are ordered by their vectors and count one by
one; with fewer rows than entries the codebook is that much shorter; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import materialize

#: Rows whose distances to all entries of a part are held at a time.
CHUNK = 4096


@dataclass
class Codes:
    """rows: vec_id, label, code, error; codebooks: entries x width integers per part."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """Hex digest of all entries' decimal components, by part, entry and position."""
        numbers = (str(x) for book in self.codebooks for entry in book.tolist() for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def padded(width: int) -> int:
    return 1 << max(width - 1, 0).bit_length()


def sequency_order(n: int) -> np.ndarray:
    """Positions in Hadamard order of the ``n`` Walsh functions by their sign changes."""
    bits = n.bit_length() - 1
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    order = np.zeros(n, np.int64)
    for b in range(bits):
        order |= ((gray >> b) & 1) << (bits - 1 - b)
    return order


def walsh(rows: np.ndarray) -> np.ndarray:
    """The transform of each row, padded with zeros, coefficients in sequency order."""
    n = padded(rows.shape[1])
    out = np.zeros((len(rows), n), np.int64)
    out[:, :rows.shape[1]] = rows
    half = 1
    while half < n:
        pairs = out.reshape(len(rows), n // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(rows), n)
        half *= 2
    return out[:, sequency_order(n)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equals) and its scaled squared distance, for transformed rows."""
    everyone = np.arange(len(points))
    first = (points[:, :1] - entries[:, 0]) ** 2
    bound = ((points - entries[first.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    partial = first[row, entry]
    for c in range(1, points.shape[1]):
        partial = partial + (points[row, c] - entries[entry, c]) ** 2
        alive = partial <= bound[row]
        row, entry, partial = row[alive], entry[alive], partial[alive]
    least = np.minimum.reduceat(partial, np.searchsorted(row, everyone))
    best = partial == least[row]
    row, entry = row[best], entry[best]
    return entry[np.searchsorted(row, everyone)], least


def whole_numbers(column: pa.ListArray, scale: int) -> np.ndarray:
    """Rows of ``floor(scale * x)`` of vectors of one length."""
    flat = np.asarray(column.flatten(), np.float64)
    return np.floor(scale * flat).astype(np.int64).reshape(len(column), -1)


def finite(vector: str) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return F.forall(vector, lambda x: F.coalesce(x - x == 0, F.lit(False)))


def _in_chunks(stream, column: int):
    for batch in stream:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            yield part, part.column(column)


def _assigned(numbers: np.ndarray, books: list[np.ndarray], waves: list[np.ndarray]):
    """Per part: the part's rows, the indexes of their entries and the squared distances."""
    width = numbers.shape[1] // len(books)
    for p, wave in enumerate(waves):
        rows = numbers[:, p * width:(p + 1) * width]
        index, distance = nearest(walsh(rows), wave)
        yield p, rows, index, distance // padded(width)


def _sums(usable: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """part, entry, n, sums of the parts assigned to each entry, one row per task and entry."""
    waves, width = [walsh(b) for b in books], books[0].shape[1]

    def run(stream):
        counts = np.zeros((len(books), len(books[0])), np.int64)
        sums = np.zeros((*counts.shape, width), np.int64)
        for _, vectors in _in_chunks(stream, 0):
            for p, rows, index, _ in _assigned(whole_numbers(vectors, scale), books, waves):
                counts[p] += np.bincount(index, minlength=counts.shape[1])
                np.add.at(sums[p], index, rows)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return usable.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def _moved(usable: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """The codebooks after one round: entries at the floor of the mean of their parts."""
    width = books[0].shape[1]
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    out = [b.copy() for b in books]
    for r in _sums(usable, books, scale).groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
        out[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out


def _coded(kept: DataFrame, usable: Column, books: list[np.ndarray], scale: int) -> DataFrame:
    """vec_id, label, code, error; null code and error where ``usable`` does not hold."""
    waves = [walsh(b) for b in books]

    def run(stream):
        for part, vectors in _in_chunks(stream, 2):
            fit = np.flatnonzero(np.asarray(vectors.is_valid()))
            codes, errors = np.zeros((len(fit), len(books)), np.uint8), np.zeros(len(fit), np.int64)
            if len(fit):
                for p, _, index, distance in _assigned(whole_numbers(vectors.take(pa.array(fit)), scale), books, waves):
                    codes[:, p] = index
                    errors += distance
            code, error = [None] * len(part), [None] * len(part)
            for i, c, e in zip(fit.tolist(), codes, errors.tolist()):
                code[i], error[i] = c.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(code, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"])

    rows = kept.select("vec_id", "label", F.when(usable, F.col("vector")).alias("vector"))
    return rows.mapInArrow(run, f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long")


def vector_codes(vectors: DataFrame, vector: str = "embedding", parts: int = 16, entries: int = 64,
                 rounds: int = 2, scale: int = 256) -> Codes:
    """Codes of all vectors of a table (vec_id, label and the vectors) and their codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("an index is written as two hex digits: at most 256 entries")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).alias("vector")).filter(
        finite("vector"))
    ranked = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    size = F.size("vector")
    first = ranked.filter((size > 0) & (size % parts == 0)).limit(1).collect()
    null = F.lit(None)
    uncoded = kept.select("vec_id", "label", null.cast("string").alias("code"), null.cast("long").alias("error"))
    if not first:
        return Codes(uncoded, [])
    width = len(first[0].vector) // parts
    most = 2**30 // padded(width)
    usable = (size == width * parts) & F.forall("vector", lambda x: F.abs(F.floor(x.cast("double") * scale)) < most)
    seeds = ranked.filter(usable).limit(entries).collect()
    if not seeds:
        return Codes(uncoded, [])
    numbers = np.floor(np.array([s.vector for s in seeds], np.float64) * scale).astype(np.int64)
    books = [numbers[:, p * width:(p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        books = _moved(kept.filter(usable), books, scale)
    return Codes(_coded(kept, usable, books, scale), books)


def with_label_errors(codes: Codes) -> DataFrame:
    """The rows with ``label_error``, the error summed over equal labels (nulls together), and the codebooks' digest."""
    rows = materialize(codes.rows)
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, rows["label"].eqNullSafe(sums["of"]), "left").select(
        "vec_id", "label", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
