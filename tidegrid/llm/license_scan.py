"""Licence scans by an exact set-similarity join, in built-in functions only.

Words are maximal runs of ASCII letters and digits and of characters beyond
ASCII, A-Z in lower case. A template is the set of its words; for a template of
n words, blocks of a text are the windows of ``2 * s`` words at every multiple
of ``s``, where s is the power of two not below n, so that any n words in a row
lie whole in one block. A block meets a template when it holds at least
``ceil(threshold * distinct words of the template)`` of them (containment).

1. Words of the templates are counted over all texts (documents that hold
   them) and ordered from rare to frequent, ties by the word itself.
2. Prefix filter: of a template with m words that must share o, a block that
   meets it holds one of the first m - o + 1. Only blocks around such a word
   are formed, as sorted lists of the template words in them.
3. Length filter (a block has at least o template words) and positional filter
   (the words left after the shared one still reach o), in the join of block
   words with template prefixes; then the whole sets are intersected.

Only template words, bounded by the templates given, reach the driver. Texts
never leave their row: forming blocks needs no shuffle, and only rows of blocks
with a rare template word are exploded, one by one, so a text or a word that
recurs in many documents is dealt over tasks as its documents are.

``base`` places are separate: phrases whose words stand one after another. Their
labels always stay; ``labels`` are these and those of the templates met.
``score`` is the highest containment of a template met, 1 where a phrase stands.

Nulls and edges: a null text counts as empty and has no words; texts are read
whole; rows are independent, so rows that repeat an id or a text repeat the
result; without places ``first_word`` and ``last_word`` are null, the labels
empty and the score 0; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import id_text, materialize
from tidegrid.llm.license_texts import TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
THRESHOLD = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_rows(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, str, int, int, list[str]]]:
    """(number, label, step of its blocks, words to share, distinct words) of every template with words."""
    out = []
    for label, text in templates:
        words = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
        if words:
            distinct = sorted(set(words))
            step = 1 << (len(words) - 1).bit_length()
            out.append((len(out), label, step, max(ceil(round(threshold * len(distinct), 9)), 1), distinct))
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _held(value: Column, make) -> Column:
    """``make(value)`` with the value computed once, not at each use inside a lambda."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words from rare to frequent by documents that hold them."""
    held = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))
    counts = id_text(docs).select(F.explode(held).alias("word")).groupBy("word").count().collect()
    n = {r["word"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _phrase_places(words: Column, starts: Column, phrase: str, label: str) -> Column:
    first, *rest = phrase.split(" ")

    def stands(s):
        ok = s["word"] == first
        for k, w in enumerate(rest, 1):
            ok = ok & F.coalesce(F.get(words, s["pos"] + k) == w, F.lit(False))
        return ok

    return F.transform(F.filter(starts, stands), lambda s: F.struct(s["pos"].alias("pos"), F.lit(label).alias("label")))


def _step_blocks(words: Column, marks: Column, step: int, prefixes: list[str], vocabulary: list[str]) -> Column:
    def around(mark):
        block = F.floor(mark["pos"] / step)
        return F.array(block, block - 1)

    def held(block):
        inside = F.slice(words, (block * step + 1).cast("int"), F.lit(2 * step))
        return F.struct(F.lit(step).alias("step"),
                        F.array_distinct(F.filter(inside, lambda w: w.isin(vocabulary))).alias("words"))

    hits = F.filter(marks, lambda m: m["word"].isin(prefixes))
    blocks = F.array_distinct(F.flatten(F.transform(hits, around)))
    return F.transform(F.filter(blocks, lambda b: b >= 0), held)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
                  phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places, labels, score for every row of ``docs``; places: array of (pos, label) of the phrases."""
    spark = docs.sparkSession
    known = template_rows(templates, threshold)
    vocabulary = sorted({w for *_, words in known for w in words})
    order = word_order(docs, vocabulary)
    rank = {w: k for k, w in enumerate(order)}
    prefixes, by_step = [], {}
    for number, label, step, share, words in known:
        ranked = sorted(words, key=rank.get)
        for i, w in enumerate(ranked[:len(ranked) - share + 1]):
            prefixes.append((step, w, number, label, i, share, len(ranked), ranked))
            by_step.setdefault(step, set()).add(w)
    by_step = {step: sorted(ws) for step, ws in sorted(by_step.items())}
    marked_words = sorted({p.split(" ")[0] for p, _ in phrases} | {w for ws in by_step.values() for w in ws})

    def marks(words):
        both = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
        return F.filter(both, lambda s: s["word"].isin(marked_words))

    def scanned(words):
        return _held(marks(words), lambda m: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.concat(*[_phrase_places(words, m, *p) for p in phrases]).alias("places"),
            F.concat(*[_step_blocks(words, m, step, ws, vocabulary) for step, ws in by_step.items()]).alias("blocks")))

    rows = materialize(id_text(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", _held(words_of(F.col("text")), scanned).alias("s")
    ).select("row", "doc_id", "s.*"))
    prefix_table = spark.createDataFrame(
        prefixes, "step int, word string, template int, label string, at int, share int, n int, template_words array<string>")
    met = _met(rows, prefix_table, order)
    found = met.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    places = F.col("places")["label"]
    none = F.array().cast("array<string>")
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", "places",
        F.array_sort(F.array_distinct(F.concat(places, F.coalesce("found", none)))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))


def _met(rows: DataFrame, prefix_table: DataFrame, order: list[str]) -> DataFrame:
    """One row or more per block and template it meets: row, label, containment."""
    ranks = F.map_from_arrays(F.array(*[F.lit(w) for w in order]), F.array(*[F.lit(k) for k in range(len(order))]))
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.step", F.col("b.words").alias("words"))
    sorted_words = F.transform(F.array_sort(F.transform(
        "words", lambda w: F.struct(F.element_at(ranks, w).alias("rank"), w.alias("word")))), lambda s: s["word"])
    blocks = blocks.withColumn("words", sorted_words)
    shared = blocks.select("*", F.posexplode("words").alias("j", "word")).join(prefix_table, ["step", "word"])
    left_over = F.least(F.col("n") - F.col("at"), F.size("words") - F.col("j"))
    candidates = shared.filter((F.size("words") >= F.col("share")) & (left_over >= F.col("share")))
    common = F.size(F.array_intersect("words", "template_words"))
    return candidates.select("row", "label", "share", "n", common.alias("common")).filter("common >= share").select(
        "row", "label", (F.col("common") / F.col("n")).alias("containment"))
