"""Keys by which values within two edits meet, on Arrow batches.

Two values within two edits are P a S and P b S, with P their longest common beginning and S the longest common
end of the rest. What differs then begins and ends with an edit, so both are P, at most one character, a common
middle M, at most one character, and S. A key is such a P, M, S: values that share one are within two edits, and a
pair within two edits shares exactly one whose P and S are the pair's own (``_short_pairs`` in ``duplicates`` tells).
A value needs only keys whose P goes on, and whose S is led up to, by different characters among the values of its
column: ``heads`` and ``tails`` hold these positions as bits. With both gaps empty, only a value with two characters more
can meet it: ``longer_heads`` and ``longer_tails`` are the bits of these positions that such a value has too.

The functions travel by value, so executors need no copy of the repository.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns made for each key, the first two its hashes. marks holds, from the lowest bit: whether a pair of one
#: character before the middle with one behind it has another key too; the gaps; the code points plus one that S is led
#: up to by and that P goes on with, 0 for none.
KEYS = "key long, check long, marks long"
#: What they are made from: texts as UTF-32, the seeds of both hashes (one pair for each column), the bits.
INPUT = ("codes", "seed", "seed2", "heads", "tails", "longer_heads", "longer_tails")
#: Gaps: a character before the middle, one behind it.
BEFORE, BEHIND = 1, 2
GAPS_AT, LAST_AT, FIRST_AT = 1, 3, 25
#: Rows of an Arrow batch that goes out, about.
BATCH_ROWS = 200_000
#: Odd multipliers of the two hashes, and of their parts.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PARTS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hash:
    """Hashes of the beginnings, ends and middles of a batch of texts."""

    def __init__(self, chars: np.ndarray, size: np.ndarray, seed: np.ndarray, base: int):
        n, width = chars.shape
        b, places = np.uint64(base), np.arange(width + 1, dtype=np.uint64)
        self.power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(width, b))))
        self.upto = np.zeros((n, width + 1), np.uint64)
        for i in range(width):
            self.upto[:, i + 1] = self.upto[:, i] * b + _mixed(chars[:, i].astype(np.uint64) + b)
        self.head = _mixed(self.upto + seed[:, None] + places * np.uint64(_PARTS[0]))
        rest = np.maximum(size[:, None] - np.arange(width + 1), 0)
        whole = np.take_along_axis(self.upto, size[:, None], 1)
        self.tail = _mixed(whole - self.upto * self.power[rest] + rest.astype(np.uint64) * np.uint64(_PARTS[1]))

    def keys(self, v: np.ndarray, p: np.ndarray, m0: np.ndarray, m1: np.ndarray, s: np.ndarray) -> np.ndarray:
        chars = m1 - m0
        middle = self.upto[v, m1] - self.upto[v, m0] * self.power[chars]
        middle = _mixed(middle + chars.astype(np.uint64) * np.uint64(_PARTS[2]))
        return _mixed(self.head[v, p] + middle * np.uint64(_PARTS[0]) + self.tail[v, s] * np.uint64(_PARTS[2]))


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-32 texts, one row per text, and the sizes of the texts."""
    size = pc.binary_length(column).to_numpy().astype(np.int64) // 4
    flat = np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.int64)
    chars = np.zeros((len(size), int(size.max()) + 1), np.int64)
    chars[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return chars, size


def _period(chars: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """For each position the length of the longest stretch from there on that repeats itself by ``step``."""
    n, width = chars.shape
    at = np.arange(width)
    left = np.maximum(size[:, None] - at, 0)
    out = np.minimum(left, step)
    for i in range(width - step - 1, -1, -1):
        goes_on = (chars[:, i] == chars[:, i + step]) & (left[:, i] > step)
        out[:, i] = np.where(goes_on, out[:, i + 1] + 1, out[:, i])
    return out


def _bits(masks: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(width)
    return ((masks[:, None] >> at & 1) == 1) & (at <= size[:, None])


def _rows(batch: pa.RecordBatch, wanted: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    chars, size = _characters(batch.column("codes"))
    heads, tails, longer_heads, longer_tails = (
        _bits(batch.column(n).to_numpy(), size, chars.shape[1]) for n in INPUT[3:])
    one, two = _period(chars, size, 1), _period(chars, size, 2)
    hashes = [
        _Hash(chars, size, batch.column(n).to_numpy().view(np.uint64), base) for n, base in zip(("seed", "seed2"), _BASES)
    ]
    owner = batch.select([n for n in batch.schema.names if n not in INPUT])

    def made(v, p, m0, m1, s, gaps, first, last, again) -> pa.RecordBatch:
        key, check = (h.keys(v, p, m0, m1, s).view(np.int64) for h in hashes)
        marks = (first + 1 << FIRST_AT) | (last + 1 << LAST_AT) | gaps << GAPS_AT | again
        columns = [*owner.take(pa.array(v)).columns, *(pa.array(x) for x in (key, check, marks))]
        return pa.RecordBatch.from_arrays(columns, [*owner.schema.names, "key", "check", "marks"])

    # Without a middle one gap comes before the other, so a single character counts as the first.
    v, p = np.nonzero(heads)
    for gaps in (g for g in wanted if g != BEHIND):
        chosen = gaps.bit_count()
        fits = p + chosen <= size[v]
        a, b = v[fits], p[fits]
        if len(a):
            first = np.where(b < size[a], chars[a, b], -1)
            last = chars[a, b + chosen - 1] if chosen else np.full(len(a), -1)
            yield made(a, b, b, b, b + chosen, gaps, first, last, 0)

    ends_of, end = np.nonzero(tails)
    n_ends = np.bincount(ends_of, minlength=len(size))
    begin = np.cumsum(n_ends) - n_ends
    each = np.repeat(np.arange(len(v)), n_ends[v])
    if not len(each):
        return
    s = end[np.arange(len(each)) - np.repeat(np.cumsum(n_ends[v]) - n_ends[v], n_ends[v]) + begin[v][each]]
    v, p = v[each], p[each]
    for gaps in wanted:
        m0, m1 = p + (gaps & BEFORE), s - (gaps >> 1)
        fits = m1 > m0
        if gaps == 0:
            fits &= longer_heads[v, p] & longer_tails[v, s]
        if gaps == BEHIND:  # the same text has its one character before such a middle
            fits &= one[v, m0] <= m1 - m0
        a, b, c, d, e = (x[fits] for x in (v, p, m0, m1, s))
        if not len(a):
            continue
        again = 0
        if gaps in (BEFORE, BEHIND):
            # A shifted run differs in two characters, which have a key of their own; of the two shifts of an
            # alternation the one with the smaller character first in the middle counts.
            other = chars[a, c + 1] if gaps == BEFORE else chars[a, np.maximum(d - 2, 0)]
            turns = (two[a, c] >= d - c) & (d - c > 1) & (chars[a, c] > chars[a, c + 1])
            again = (one[a, c] >= d - c) | (turns & (chars[a, b if gaps == BEFORE else d] == other))
        yield made(a, b, c, d, e, gaps, chars[a, b], chars[a, e - 1], again)


def gap_keys(*wanted: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The columns besides ``INPUT`` and ``KEYS`` for every key with the ``wanted`` gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = [
                np.array([x.bit_count() for x in batch.column(n).to_pylist()]) for n in ("heads", "tails")
            ]
            before = np.cumsum(len(wanted) * counts[0] * (counts[1] + 1)) // BATCH_ROWS
            cuts = np.flatnonzero(np.diff(before)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield from _rows(batch.slice(a, b - a), wanted)

    return run
