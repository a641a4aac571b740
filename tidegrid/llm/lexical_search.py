"""Ranked lexical search by norm buckets of impact vectors.

A document is the vector of its term impacts, an item the vector of its term
weights, a score their product. Terms that no item holds add nothing, so only
the items' terms are kept of a document.

1. One pass over the texts counts the items' terms in each document; sums over
   all documents give N, L and the document frequencies.
2. Impacts follow, and the vectors are written in order of their length (norm),
   range-partitioned, so that files and their row groups are buckets of norms.
3. The longest vectors are searched first; the k-th best score of each item is
   a threshold for the rest. By Cauchy-Schwarz a vector whose norm times the
   item's norm is below the threshold cannot reach it: the scan skips what is
   below every item's bound, a task skips buckets item by item.
4. Inside a bucket, the coordinates of the item's largest weights must lie in
   the interval that the threshold's cosine allows. What is left is scored in
   64-bit integers; only scores reach the ranking. Thresholds rise on the way.

A bound is widened by a relative 1e-9 before it may drop anything, so rounding
never loses a document; results are those of scoring every pair.

Items are read in blocks of ``BLOCK_CHARS`` characters (a stated query set);
each block passes over the documents once. The driver holds a block, its
document frequencies and thresholds. A task sends at most k documents an item.

Nulls and edges: null and empty texts have no terms; items without terms have
no rows; rows that repeat a ``doc_id`` are documents of their own; a null
``doc_id`` ranks before others of equal score; items equal in id and text count
once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegrid.llm.common import batches_of_texts, id_text, materialize, text_of

BLOCK_CHARS = 4_000_000
#: Vectors of a bucket, coordinates whose interval is tried, share of the vectors that is searched first.
BUCKET, FOCUS, HEAD = 1024, 3, 1 / 16
SLACK = 1e-9
NO_ID = -(2**63)
#: ASCII letters and digits stay (A-Z in lower case), other ASCII characters part terms, bytes beyond ASCII stay.
_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def item_blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item id, its terms) in blocks of bounded size."""
    block, size = [], 0
    rows = items.select("item_id", text_of().alias("text")).distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        if block and size + len(row.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.item_id, sorted(set(terms_of(row.text)))))
        size += len(row.text)
    if block:
        yield block


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers, 32 bits each), counts; documents with a term."""

    def run(stream):
        for batch in stream:
            for part in batches_of_texts([batch]):
                n, terms, counts = [], [], []
                for text in part.column(1).to_pylist():
                    words = terms_of(text)
                    found = Counter(words)
                    known = sorted((vocabulary[w], found[w]) for w in found.keys() & vocabulary.keys())
                    n.append(len(words))
                    terms.append(np.array([t for t, _ in known], np.int32).tobytes())
                    counts.append(np.array([c for _, c in known], np.int32).tobytes())
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                    ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    rows = id_text(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term."""

    def run(stream):
        total = np.zeros(size, np.int64)
        for batch in stream:
            total += np.bincount(_joined(batch.column(0), np.int32), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    out = np.zeros(size, np.int64)
    sums = counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for row in sums.collect():
        out[row.term] = row.df
    return out


def _joined(column: pa.BinaryArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def impact_vectors(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, norm, terms, impacts (64 bits each); documents with a term of the items."""

    def run(stream):
        for batch in stream:
            lengths = np.array([len(x) // 4 for x in batch.column(2).to_pylist()], np.int64)
            m = np.array([50 + (50 * n * n_docs) // n_terms for n in batch.column(1).to_pylist()], np.int64)
            tf = _joined(batch.column(3), np.int32).astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, lengths))
            held = lengths > 0
            ends = np.cumsum(lengths)
            squares = np.add.reduceat(impact.astype(np.float64) ** 2, (ends - lengths)[held]) if held.any() else np.empty(0)
            kept = batch.filter(pa.array(held))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), pa.array(np.sqrt(squares)), kept.column(2),
                 pa.array([impact[e - k:e].tobytes() for e, k in zip(ends[held], lengths[held])], pa.binary())],
                ["doc_id", "norm", "terms", "impacts"])

    return counted.mapInArrow(run, "doc_id long, norm double, terms binary, impacts binary")


class _Bucket:
    """Vectors of a bucket by term."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, terms: list[bytes], impacts: list[bytes]):
        self.ids, self.norms, self.top = ids, norms, norms.max()
        at = np.frombuffer(b"".join(terms), np.int32)
        order = np.argsort(at, kind="stable")
        self.terms = at[order]
        self.rows = np.repeat(np.arange(len(ids)), [len(t) // 4 for t in terms])[order]
        self.impacts = np.frombuffer(b"".join(impacts), np.int64)[order]

    def postings(self, terms: np.ndarray):
        lo, hi = np.searchsorted(self.terms, terms), np.searchsorted(self.terms, terms, side="right")
        return [(self.rows[a:b], self.impacts[a:b]) for a, b in zip(lo, hi)]

    def reaching(self, weights: np.ndarray, norm: float, postings, threshold: int) -> np.ndarray:
        """Which vectors may reach the threshold: by length, then by the item's largest coordinates."""
        cosine = threshold / (self.norms * norm) * (1 - SLACK)
        alive = cosine <= 1
        if threshold <= 0:
            return alive
        rest = np.sqrt(np.maximum(1 - cosine**2, 0))
        for f in range(min(FOCUS, len(weights))):
            q = weights[f] / norm
            value = np.zeros(len(self.ids))
            value[postings[f][0]] = postings[f][1]
            value /= self.norms
            spread = rest * np.sqrt(max(1 - q * q, 0)) + SLACK
            alive &= (value >= q * cosine - spread) & (value <= q * cosine + spread + _above(q, cosine))
        return alive

    def scores(self, weights: np.ndarray, postings, alive: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ids), np.int64)
        few = 4 * int(alive.sum()) < len(alive)
        for w, (rows, impacts) in zip(weights.tolist(), postings):
            if few:
                kept = alive[rows]
                rows, impacts = rows[kept], impacts[kept]
            out[rows] += w * impacts
        return out


def _above(q: float, cosine: np.ndarray) -> np.ndarray:
    """How far above the threshold's interval a coordinate may lie when the cosine is higher than the threshold.

    The upper end of the interval is a bound only for cosines up to q: a vector that points along the
    coordinate has value 1 and cosine q.
    """
    return np.where(cosine <= q, 2.0, 0.0)


def best_documents(vectors: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], k: int,
                   thresholds: np.ndarray) -> DataFrame:
    """item (number), doc_id, score: the k best of each task with a score above 0 and not below the threshold."""
    norms = np.array([np.sqrt((w.astype(np.float64) ** 2).sum()) for _, w in items])

    def run(stream):
        least = np.maximum(thresholds, 1)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]

        def search(rows):
            bucket = _Bucket(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]),
                             [r[2] for r in rows], [r[3] for r in rows])
            for q in np.flatnonzero(norms * bucket.top * (1 + SLACK) >= least):
                terms, weights = items[q]
                postings = bucket.postings(terms)
                alive = bucket.reaching(weights, norms[q], postings, int(least[q]))
                if not alive.any():
                    continue
                scores = bucket.scores(weights, postings, alive)
                found = np.flatnonzero(alive & (scores >= least[q]))
                if len(found):
                    s, ids = (np.concatenate(x) for x in zip(best[q], (scores[found], bucket.ids[found])))
                    order = np.lexsort((ids, -s))[:k]
                    best[q] = (s[order], ids[order])
                    if len(order) == k:
                        least[q] = max(least[q], s[order[-1]])

        waiting = []
        for batch in stream:
            waiting += zip(*(c.to_pylist() for c in batch.columns))
            while len(waiting) >= BUCKET:
                search(waiting[:BUCKET])
                waiting = waiting[BUCKET:]
        if waiting:
            search(waiting)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(items), dtype=np.int32), [len(s) for s, _ in best])),
             pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))],
            ["item", "doc_id", "score"])

    return vectors.select("doc_id", "norm", "terms", "impacts").mapInArrow(run, "item int, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, block: list[tuple[object, list[bytes]]], k: int) -> DataFrame:
    """item (number in the block), rank, doc_id, score."""
    vocabulary = {w: t for t, w in enumerate(sorted({w for _, words in block for w in words}))}
    counted = materialize(count_terms(docs, vocabulary))
    totals = counted.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    df = document_frequencies(counted, len(vocabulary))
    weight = [floor(1000 * log((2 * totals.n + 2) / (2 * int(x) + 1))) for x in df]
    items = []
    for _, words in block:
        pairs = sorted(((weight[vocabulary[w]], vocabulary[w]) for w in words), reverse=True)
        pairs = [p for p in pairs if p[0] > 0 and df[p[1]] > 0]
        items.append((np.array([t for _, t in pairs], np.int32), np.array([w for w, _ in pairs], np.int64)))
    by_norm = impact_vectors(counted, totals.n, totals.l or 1).repartitionByRange(F.desc("norm"), "doc_id")
    vectors = materialize(by_norm.sortWithinPartitions(F.desc("norm")))
    cut = vectors.agg(F.percentile_approx("norm", 1 - HEAD)).first()[0] or 0.0
    none = np.zeros(len(items), np.int64)
    first = materialize(ranked(best_documents(vectors.filter(F.col("norm") >= cut), items, k, none), k))
    for row in first.filter(F.col("rank") == k).select("item", "score").collect():
        none[row.item] = row.score
    norms = [float(np.sqrt((w.astype(np.float64) ** 2).sum())) for _, w in items]
    least = min((t / n for t, n in zip(none.tolist(), norms) if n), default=0.0) * (1 - SLACK)
    rest = vectors.filter((F.col("norm") < cut) & (F.col("norm") >= least))
    more = best_documents(rest, items, k, none)
    return ranked(first.select("item", "doc_id", "score").unionByName(more), k)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    out = []
    for block in item_blocks(items):
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item int, item_id {kind}")
        out.append(search_block(docs, block, k).join(names, "item").select(
            "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    empty = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out) if out else empty
