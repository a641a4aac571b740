"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are ratios and counts; each is cut into bins at quantiles
of the training rows. Training cycles through the features: every step fits a
shallow tree of at most four leaves on one feature's bins to the gradient and
adds it, shrunk, to that feature's lookup table. The pairs with the largest
gain on the residuals then get two-way tables in the same manner. Scoring a
row is one table lookup per feature and pair, summed; it is vectorised over
Arrow batches.

Only the labels of rows with ``crc32(doc_id as text) % 5 != 0`` are used;
labels, lang, source and doc_id are no inputs. The model is fitted on at most
``max_rows`` labelled rows (the first by a hash of the id), a bounded table
that fits one task; everything else runs over all rows.

Nulls and edges: null and empty texts get the features of an empty text and a
score; a null ``doc_id`` is never held out and never trained on; conflicting
labels of an id count as separate rows; without usable labels of both kinds
every score is the label mean (0.5 without labels); further columns pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import batches_of_texts, fresh_names, id_text, materialize, with_fields

MAX_ROWS = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 60, 30, 0.2, 4

FEATURES = (
    "log_chars", "words", "mean_word", "long_words", "upper", "digits", "marks", "spaces", "commas", "stops",
    "bars", "symbols", "shouts", "distinct_words", "distinct_lines", "line_chars", "sentence_words", "short_lines",
    "run_share", "non_ascii",
)
_RUNS = re.compile(r"([^\w\s])\1+")


def text_features(text: str) -> list[float]:
    """One number per name in ``FEATURES``."""
    n = len(text) or 1
    words = text.split()
    w = len(words) or 1
    lines = text.split("\n")
    word_chars = sum(map(len, words))
    count = text.count
    upper = sum(map(str.isupper, words))
    letters = len(re.findall(r"\w", text))
    digits = len(re.findall(r"[0-9]", text))
    stops = count(".") + count("?")
    symbols = sum(map(count, "*&%$#@^~=<>{}[]\\_"))
    return [
        np.log1p(len(text)), np.log1p(len(words)), word_chars / w, sum(len(x) > 20 for x in words) / w,
        upper / w, digits / n, (n - letters) / n, (n - word_chars) / n, count(",") / w, stops / w,
        count("|") / w, symbols / w, count("!") / w, len(set(words)) / w, len(set(lines)) / len(lines),
        n / len(lines), w / (stops + 1), sum(len(x) < 20 for x in lines) / len(lines),
        sum(len(m.group()) for m in _RUNS.finditer(text)) / n, 1 - len(text.encode("ascii", "ignore")) / n,
    ]


def feature_matrix(texts: list[str]) -> np.ndarray:
    return np.array([text_features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf value per bin of a tree that splits the ordered bins best-first."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])

    def best(lo: int, hi: int):
        cuts = np.arange(lo + 1, hi)
        if not len(cuts):
            return -1.0, lo
        gain = ((g[cuts] - g[lo]) ** 2 / (h[cuts] - h[lo] + 1)
                + (g[hi] - g[cuts]) ** 2 / (h[hi] - h[cuts] + 1))
        k = int(np.argmax(gain))
        return gain[k] - (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + 1), int(cuts[k])

    spans = [(0, len(gradient))]
    while len(spans) < leaves:
        gains = [best(*s) for s in spans]
        k = max(range(len(spans)), key=lambda i: gains[i][0])
        if gains[k][0] <= 1e-9:
            break
        (lo, hi), cut = spans[k], gains[k][1]
        spans[k:k + 1] = [(lo, cut), (cut, hi)]
    out = np.zeros(len(gradient))
    for lo, hi in spans:
        out[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + 1)
    return out


def shallow_tree_2d(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Leaf values of the best cross: one cut in each of two directions."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight))
    n, m = gradient.shape
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]

    def corners(t):
        a = t[i, j]
        b, c = t[i, m] - a, t[n, j] - a
        return a, b, c, t[n, m] - a - b - c

    parts_g, parts_h = corners(g), corners(h)
    gain = sum(x**2 / (y + 1) for x, y in zip(parts_g, parts_h))
    k = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [x[k] / (y[k] + 1) for x, y in zip(parts_g, parts_h)]
    out = np.empty((n, m))
    a, b = k[0] + 1, k[1] + 1
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = values
    return out


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"),
                           np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of ``y`` (0 or 1) on the columns of ``x``."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    n_features = len(FEATURES)
    edges = [_edges(x[:, f], BINS) if len(y) else np.empty(0) for f in range(n_features)]
    pair_edges = [_edges(x[:, f], PAIR_BINS) if len(y) else np.empty(0) for f in range(n_features)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(float(np.log(mean / (1 - mean))), edges, tables, [], pair_edges, [])
    if len(set(y.tolist())) < 2:
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(n_features):
            g, h = slopes()
            size = len(tables[f])
            tree = RATE * shallow_tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size), LEAVES)
            tables[f] += tree
            total += tree[bins[f]]

    def grid(a, b, values):
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = {}
    for a, b in combinations(range(n_features), 2):
        if len(pair_edges[a]) and len(pair_edges[b]):
            gains[a, b] = float((grid(a, b, g) ** 2 / (grid(a, b, h) + 1)).sum())
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    model.pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            tree = RATE * shallow_tree_2d(grid(a, b, g), grid(a, b, h))
            table += tree
            total += tree[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(
        "doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = materialize(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows))
    schema = "quality int, features array<double>"

    def featurise(stream):
        for batch in stream:
            for part in batches_of_texts([batch]):
                x = feature_matrix(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["quality", "features"])

    # ``chosen`` has at most ``max_rows`` ids, so it is small enough to broadcast.
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(
        F.min("text").alias("text")).select("quality", "text").mapInArrow(featurise, schema).collect()
    x = np.array([r.features for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    y = np.array([r.quality for r in rows], dtype=float)
    order = np.lexsort((*x.T, y)) if len(rows) else slice(None)  # the same fit whatever order rows arrive in
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` followed by the score (0 to 1) and the prediction (0 or 1).

    These last two columns are named score and predicted, with underscores before where taken.
    """
    added = fresh_names(docs, "score", "predicted")
    schema = with_fields(docs, dict(zip(added, ("double", "int"))))
    names, at = docs.columns, docs.columns.index("text")

    def run(stream):
        for batch in stream:
            for part in batches_of_texts([batch]):
                texts = [t or "" for t in part.column(at).to_pylist()]
                scores = model.score(feature_matrix(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores), pa.array((scores >= threshold).astype("int32"))],
                    names=[*names, *added])

    return docs.mapInArrow(run, schema)
