"""Pseudonymisation and dictionary translation of cells and headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.functions import cells as fx

KEY_CHARS = 20


def _salted(salt: str, key: Column) -> Column:
    """A non-negative number of 60 bits from a salted digest."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")), 256)
    return F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long")


def pseudonym(c: Column, pool: list[str], salt: str) -> Column:
    """Same leading 20 characters, same replacement; blank cells stay.

    A salted hash picks the pool entry, so tasks agree without sharing a map.
    """
    key = F.left(fx.trim_ws(c), F.lit(KEY_CHARS))
    nth = (_salted(salt, key) % len(pool)).cast("int")
    return F.when(fx.is_empty(c), c).otherwise(F.get(F.array(*[F.lit(p) for p in pool]), nth))


def masked_code(c: Column, kind: str, low: int, high: int, row_id: Column, salt: str) -> Column:
    """``kind``, a dash and a number from ``low`` to ``high``."""
    number = _salted(salt, row_id) % (high - low + 1) + low
    masked = F.concat(F.lit(f"{kind}-"), number.cast("string"))
    return F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(masked)


def translate_header(name: Column, exact: dict[str, str]) -> Column:
    """Exact translation, else the first line holding Latin letters, else the header itself."""
    lines = F.transform(F.split(name, "\n"), fx.trim_ws)
    latin = F.filter(lines, lambda p: p.rlike("[A-Za-z]"))
    kept = F.when(F.contains(name, F.lit("\n")) & (F.size(latin) > 0), F.get(latin, F.lit(0)))
    if exact:
        table = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])
        return F.coalesce(F.try_element_at(table, name), kept, name)
    return F.coalesce(kept, name)


def translate_header_by_part(name: Column, parts: dict[str, str]) -> Column:
    """The translation of the first dictionary entry contained in the header."""
    hits = [F.when(F.contains(name, F.lit(zh)), F.lit(en)) for zh, en in parts.items()]
    return F.coalesce(*hits, name)


def translate_value(c: Column, words: dict[str, str]) -> Column:
    """Ordered substring replacements."""
    return reduce(lambda v, kv: F.replace(v, F.lit(kv[0]), F.lit(kv[1])), words.items(), c)


def strip_cjk(c: Column, words: dict[str, str]) -> Column:
    """Translate CJK cells, then drop what is left of the script; empty results become null."""
    done = translate_value(c, words)
    stripped = fx.trim_ws(F.regexp_replace(done, f"{lx.CJK_EXTENDED_CLASS}+", ""))
    cleaned = F.when(fx.has_residual_cjk(done), stripped).otherwise(done)
    return F.when(fx.has_residual_cjk(c), F.nullif(cleaned, F.lit(""))).otherwise(c)
