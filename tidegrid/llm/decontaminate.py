"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in a normal form: lower case, with every run of characters
other than letters and digits made one space. A test item of ``m`` characters
may differ from a passage by up to ``k = floor(rate * m)`` edits. Cut into
``k + 1`` pieces, at least one piece of it occurs unchanged in such a passage.
An Aho-Corasick automaton finds the pieces in the documents; round each hit
the window that could hold the item is checked with Myers' bit-parallel edit
distance. No passage within the budget is missed.

The items are read in blocks of at most ``BLOCK_CHARS`` characters, so an
automaton and what is broadcast stay bounded; each block is one pass over the
documents.

Nulls and edges: null and empty texts match nothing; an item with a normal
form shorter than 20 characters has no budget and must stand whole between
words; one without letters and digits, or null, is left out; a null ``item_id`` is reported as null; equal items are reported each; rows are
independent, so repeated rows repeat; without items no document matches;
further columns pass through, also one that is named as the added one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import batches_of_texts, fresh_names, materialize, with_fields

RATE = 0.05
BLOCK_CHARS = 4_000_000
_GAPS = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _GAPS.sub(" ", text.lower()).strip()


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate)


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces (offset, piece) of nearly equal length that together are the text."""
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_distance(masks: dict[str, int], m: int, window: str, enough: int = 0) -> int:
    """Least edit distance between the pattern and any part of ``window``; stops at ``enough``.

    Bit ``i`` of a vector stands for row ``i`` of the column of the dynamic programme; a column
    costs a fixed number of operations on whole vectors.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in window:
        equal = masks.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rises = down | (full & ~(horizontal | up))
        falls = up & horizontal
        if rises & top:
            score += 1
        elif falls & top:
            score -= 1
            if score < best:
                best = score
                if best <= enough:
                    break
        rises, falls = (rises << 1) & full, (falls << 1) & full
        up = falls | (full & ~(vertical | rises))
        down = rises & vertical
    return best


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _at_words(form: str, start: int, end: int) -> bool:
    return (start == 0 or form[start - 1] == " ") and (end == len(form) or form[end] == " ")


@dataclass
class Matcher:
    """Automaton over the pieces of a block of items (item_id, normal form)."""

    items: list[tuple[int | None, str]]
    rate: float

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, budget(len(text), self.rate)):
                places.setdefault(piece, []).append((number, offset))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def find(self, text: str) -> list[tuple[int | None, int]]:
        """(item_id, least distance found) of the items that occur in a text."""
        form, starts = normal(text), {}
        for end, (length, where) in self.automaton.iter(form):
            for number, offset in where:
                starts.setdefault(number, []).append(end + 1 - length - offset)
        out = []
        for number, at in sorted(starts.items()):
            item_id, item = self.items[number]
            k, m = budget(len(item), self.rate), len(item)
            best, done = k + 1, -1
            for start in sorted(set(at)):
                if start >= 0 and form.startswith(item, start) and (k or _at_words(form, start, start + m)):
                    best = 0
                    break
            else:
                if number not in self.masks:
                    self.masks[number] = masks_of(item)
                for start in sorted(set(at)) if k else ():
                    lo, hi = max(start - k, 0), min(start + m + k, len(form))
                    if hi <= done:
                        continue
                    best = min(best, best_distance(self.masks[number], m, form[lo:hi]))
                    done = hi
                    if best == 0:
                        break
            if best <= k:
                out.append((item_id, best))
        return out


def _blocks(items: DataFrame):
    """The items in blocks of bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").filter("text is not null").toLocalIterator():
        text = normal(row.text)
        if not text:
            continue
        if size + len(text) > BLOCK_CHARS and block:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


def mark_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` followed by an array of (item_id, distance), empty for clean documents.

    This last column is named hits, with underscores before where taken.
    """
    spark, names, at = docs.sparkSession, docs.columns, docs.columns.index("text")
    (added,) = fresh_names(docs, "hits")
    hit = "array<struct<item_id:bigint,distance:bigint>>"
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64())]))
    marked = docs.withColumn(added, F.array().cast(hit))
    schema = with_fields(docs, {added: hit})

    def one_pass(block):
        def run(stream):
            matcher = Matcher(block.value, rate)
            for batch in stream:
                for part in batches_of_texts([batch]):
                    before = part.column(len(names)).to_pylist()
                    found = [known + [{"item_id": i, "distance": d} for i, d in matcher.find(t or "")]
                             for t, known in zip(part.column(at).to_pylist(), before)]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-1], pa.array(found, arrow)], names=[*names, added])

        return run

    for n, block in enumerate(_blocks(items)):
        if n:  # further blocks: the passes follow each other over a written table
            marked = materialize(marked)
        marked = marked.mapInArrow(one_pass(spark.sparkContext.broadcast(block)), schema)
    return marked
