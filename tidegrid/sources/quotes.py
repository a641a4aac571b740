"""Quote states of CSV lines and the records they form, one file split after the other, on Arrow batches.

The functions take the lines of a scan in the order of the file; a task holds whole splits. They travel
by value, so executors need no copy of the repository.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_EFFECTS = "file string, start long, from_out int, from_in int, n_out long, n_in long"
PIECES = "row_idx long, file_no long, file_row long, start long, value string, part boolean"
_PIECE_TYPES = pa.schema([("row_idx", pa.int64()), ("file_no", pa.int64()), ("file_row", pa.int64()),
                          ("start", pa.int64()), ("value", pa.string()), ("part", pa.bool_())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(file, start) and the rows of a batch that belong to it, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column("file").dictionary_encode().indices.to_numpy()
        start = batch.column("start").to_numpy()
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(start) != 0)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            run = batch.slice(a, b - a)
            yield (run.column("file")[0].as_py(), run.column("start")[0].as_py()), run


def _after(run: pa.RecordBatch, state: int) -> np.ndarray:
    """The state behind each line: the last setting before it, and the swaps since then."""
    out, into = run.column("from_out").to_numpy(), run.column("from_in").to_numpy()
    swaps = np.cumsum(out > into)
    last = np.maximum.accumulate(np.where(out == into, np.arange(len(out)), -1))
    since = np.where(last >= 0, swaps - swaps[last], swaps)
    return np.where(last >= 0, out[last], state) ^ (since & 1)


def _begins(run: pa.RecordBatch, state: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines begin a record, and before which a quoted cell is open."""
    inside = np.concatenate(([state], after[:-1])) == 1
    return ~inside & ~run.column("blank").to_numpy(zero_copy_only=False), inside


def split_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: the state behind it and the records it begins, when none or one cell was open before it."""
    done, split, states, counts = [], None, [0, 1], [0, 0]
    for at, run in _runs(batches):
        if at != split:
            if split:
                done.append((*split, *states, *counts))
            split, states, counts = at, [0, 1], [0, 0]
        for k, state in enumerate(states):
            after = _after(run, state)
            counts[k] += int(_begins(run, state, after)[0].sum())
            states[k] = int(after[-1])
    if split:
        done.append((*split, *states, *counts))
        names = ["file", "start", "from_out", "from_in", "n_out", "n_in"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)


def record_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines that know the state at the start of their split (entry) and the number of records before it.

    Lines of a record are joined by line feeds. A record that goes on in a later split comes in parts: the one it
    begins with and, for the split's leading lines, the position before the split's first record.
    """
    split, state, place, n, held = None, 0, (0, 0, 0), 0, []

    def pieces(first: int, texts: pa.Array, part: bool) -> pa.RecordBatch:
        offset, file_offset, file_no = place
        at = np.arange(first, first + len(texts))
        return pa.RecordBatch.from_arrays(
            [pa.array(offset + at), pa.array(np.full(len(at), file_no)), pa.array(file_offset + at),
             pa.array(np.full(len(at), split[1])), texts, pa.array(np.full(len(at), part))], schema=_PIECE_TYPES)

    def last(ended: bool) -> Iterator[pa.RecordBatch]:
        """The record that the lines held so far make."""
        if held:
            text = "\n".join(x for lines in held for x in lines.to_pylist())
            yield pieces(n - 1, pa.array([text], pa.string()), n == 0 or (ended and state == 1))
            held.clear()

    for at, run in _runs(batches):
        if at != split:
            yield from last(True)
            first = run.slice(0, 1).to_pylist()[0]
            split, state, n = at, first["entry"], 0
            place = first["offset"], first["file_offset"], first["file_no"]
        after = _after(run, state)
        begins, inside = _begins(run, state, after)
        kept = np.flatnonzero(begins | inside)
        lines, heads = run.column("value").take(pa.array(kept)), np.flatnonzero(begins[kept])
        if len(heads):
            if heads[0]:
                held.append(lines.slice(0, heads[0]))
            yield from last(False)
            whole = pa.ListArray.from_arrays(pa.array(heads, pa.int32()), lines)
            yield pieces(n, pc.binary_join(whole, "\n"), False)
            n += len(heads)
            held.append(lines.slice(heads[-1]))
        elif len(lines):
            held.append(lines)
        state = int(after[-1])
    yield from last(True)
