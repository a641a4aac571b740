"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.session import materialize

#: Rows of one Arrow batch of whole texts; Spark also closes a batch by its bytes.
TEXT_ROWS = 1024


def text_of(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_text(df: DataFrame, *others: str) -> DataFrame:
    """Only the columns an operator works on, so that further columns cannot clash with its own."""
    return df.select("doc_id", text_of().alias("text"), *others)


def batches_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller slices of Arrow batches: whole texts are decoded ``TEXT_ROWS`` at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, TEXT_ROWS):
            yield batch.slice(start, TEXT_ROWS)


def per_worker(kind: str, key: str, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for its later tasks.

    Functions of this subpackage travel by value, so their module variables are new in every task;
    the object is held by a module of the worker process. One object of a kind is held at a time.
    """
    home = sys.modules.setdefault("_tidegrid_worker", types.ModuleType("_tidegrid_worker"))
    held = home.__dict__.setdefault("held", {})
    if kind not in held or held[kind][0] != key:
        held[kind] = (key, make())
    return held[kind][1]


def with_fields(df: DataFrame, fields: dict[str, str] | None = None, **named: str) -> T.StructType:
    """The schema of ``df`` followed by further fields; null texts may have become empty ones."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in ((fields or {}) | named).items())])


def free_worker() -> None:
    """Let go of what ``per_worker`` holds, for tasks that need the memory themselves."""
    held = getattr(sys.modules.get("_tidegrid_worker"), "held", None)
    if held:
        held.clear()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def keep_columns(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``decided`` with the columns of ``docs`` only, in their order."""
    return decided.select(*[F.col(f"`{c}`") for c in docs.columns])


__all__ = ["batches_of_texts", "free_worker", "fresh_names", "id_text", "keep_columns", "materialize", "per_worker", "text_of", "with_fields"]
