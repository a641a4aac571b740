"""Cell predicates as Column expressions.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation and can be used on any string column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid import lexicon as lx


def trim_ws(c: Column) -> Column:
    """Trim Unicode white space (``F.trim`` alone strips only U+0020)."""
    return F.trim(c, F.lit(lx.WHITESPACE))


def is_empty(c: Column) -> Column:
    # Trimmed at the left only, which stops at the first other character.
    return F.coalesce(F.ltrim(c, F.lit(lx.WHITESPACE)), F.lit("")) == ""


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def count_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions], F.lit(0))


def is_date(v: Column) -> Column:
    """``v`` is already trimmed, here and in the other ``v`` predicates."""
    return v.rlike(lx.DATE_PATTERN)


def is_numeric_format(v: Column) -> Column:
    return v.rlike(lx.NUMERIC_PATTERN)


def is_boolean(v: Column) -> Column:
    return F.lower(v).isin(lx.BOOLEAN_WORDS)


def format_type(c: Column) -> Column:
    v = trim_ws(c)
    return (
        F.when(is_date(v), "DATE")
        .when(is_numeric_format(v), "NUMERIC")
        .when(is_boolean(v), "BOOLEAN")
        .otherwise("TEXT")
    )


def format_label(fmt: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in lx.FORMAT_LABELS.items() for x in kv])
    return F.element_at(labels, fmt)


def _parses(cleaned: Column) -> Column:
    # A bare try_cast would accept "1d" and turn "1e400" into infinity.
    finite = F.abs(cleaned.try_cast("double")) < F.lit(float("inf"))
    return F.coalesce(
        (cleaned.rlike(lx.FLOAT_PATTERN) & finite)
        | F.lower(cleaned).rlike(lx.FLOAT_WORD_PATTERN),
        F.lit(False),
    )


def is_num(c: Column) -> Column:
    return _parses(F.replace(trim_ws(c), F.lit(","), F.lit("")))


def is_bare_num(v: Column) -> Column:
    """``is_num`` of a trimmed text without commas."""
    return _parses(v)


def is_numeric_currency(c: Column) -> Column:
    """Numeric after one leading currency code and any outer currency symbols are removed."""
    v = trim_ws(c)
    without_prefix = reduce(
        lambda rest, p: F.when(
            F.startswith(v, F.lit(p)), trim_ws(F.substr(v, F.lit(len(p) + 1)))
        ).otherwise(rest),
        reversed(lx.CURRENCY_PREFIXES),
        v,
    )
    bare = trim_ws(F.trim(without_prefix, F.lit(lx.CURRENCY_SYMBOLS)))
    return _parses(F.replace(bare, F.lit(","), F.lit("")))


def looks_like_date(v: Column) -> Column:
    """Six to twelve bytes with two separators and four digits or more."""
    marks = v.rlike("[-/.][^-/.]*[-/.]") & v.rlike("[0-9](?:[^0-9]*[0-9]){3}")
    return F.when(F.octet_length(v).between(6, 12), marks).otherwise(False)


def is_header_date(v: Column) -> Column:
    return v.rlike(lx.HEADER_DATE_PATTERN)


def is_placeholder(c: Column) -> Column:
    return trim_ws(c).rlike(lx.PLACEHOLDER_PATTERN)


def is_identifier_like(c: Column) -> Column:
    return trim_ws(c).rlike(lx.IDENTIFIER_PATTERN)


def contains_newline(c: Column) -> Column:
    return F.contains(c, F.lit("\n"))


def contains_cjk(c: Column) -> Column:
    return c.rlike(lx.CJK_CLASS)


def has_residual_cjk(c: Column) -> Column:
    return c.rlike(lx.CJK_EXTENDED_CLASS)


def has_word(c: Column, words: list[str]) -> Column:
    lowered = F.lower(c)
    return any_of([F.contains(lowered, F.lit(w)) for w in words])


def is_subtotal_cell(c: Column, whole_word: bool = False) -> Column:
    if whole_word:
        return F.lower(trim_ws(c)).isin(lx.SUBTOTAL_WORDS)
    # "subtotal" contains "total", so three substrings decide.
    return has_word(c, [w for w in lx.SUBTOTAL_WORDS if w != "subtotal"])


def has_bracket(c: Column) -> Column:
    return F.contains(c, F.lit("(")) | F.contains(c, F.lit("（"))


def has_cjk_bracket_note(c: Column) -> Column:
    """First opening bracket, first closing bracket after it (kinds may mix), CJK between."""
    cjk = lx.CJK_CLASS
    return c.rlike(f"^[^(（]*[(（][^)）]*{cjk}[^)）]*[)）]")


def is_remark_content(inner: Column) -> Column:
    t = trim_ws(inner)
    return F.when(t == "", False).when(contains_cjk(t), True).otherwise(
        ~t.rlike("^[vV][0-9]+$") & ~t.rlike("^[0-9.,]+$") & (F.length(t) > 5)
    )


def bracket_contents(c: Column) -> Column:
    """Inner texts of bracket pairs, left to right, stopping at the first unclosed bracket."""
    pairs = F.regexp_extract_all(c, F.lit(r"\G[^(（]*(?:\([^)]*\)|（[^）]*）)"), F.lit(0))
    return F.transform(
        pairs,
        lambda p: F.regexp_extract(p, r"^[^(（]*[(（]([\s\S]*)[)）]$", 1),
    )


def has_inline_remark(c: Column) -> Column:
    return F.when(
        has_bracket(c), F.exists(bracket_contents(c), is_remark_content)
    ).otherwise(False)


def truncate(c: Column, n: int = 40) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def display_name(name: Column, col_idx: Column) -> Column:
    shown = F.replace(F.replace(trim_ws(name), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.when(is_empty(name), F.format_string("第%d欄", col_idx + 1)).otherwise(shown)


def round1(x: Column) -> Column:
    return F.round(x * 10) / 10


def strip_suffix(c: Column) -> Column:
    """Remove one company suffix; the longest suffix is also the leftmost match."""
    suffixes = "|".join(s.replace(".", "[.]") for s in lx.COMPANY_SUFFIXES)
    return trim_ws(F.regexp_replace(trim_ws(c), f"({suffixes})$", ""))


def entity_key(c: Column) -> Column:
    return F.lower(strip_suffix(c))


def remove_bracket_notes_once(c: Column) -> Column:
    cjk = lx.CJK_CLASS
    half = F.regexp_replace(c, rf"^([^(]*)\([^)]*{cjk}[^)]*\)", "$1")
    return F.regexp_replace(half, f"^([^（]*)（[^）]*{cjk}[^）]*）", "$1")


def has_removable_note(c: Column) -> Column:
    cjk = lx.CJK_CLASS
    return c.rlike(rf"^[^(]*\([^)]*{cjk}[^)]*\)") | c.rlike(f"^[^（]*（[^）]*{cjk}[^）]*）")


def split_last_remark(c: Column) -> tuple[Column, Column]:
    """(text before the last remark bracket, remark) with a null remark if there is none."""

    def last(open_, close, cls_open, cls_close):
        inner = F.regexp_extract(c, f"{cls_open}([^{open_}{close}]*){cls_close}[^{open_}]*$", 1)
        found = c.rlike(f"{cls_open}[^{open_}{close}]*{cls_close}[^{open_}]*$")
        before = trim_ws(F.regexp_extract(c, rf"^([\s\S]*){cls_open}[^{open_}]*$", 1))
        return found & (contains_cjk(inner) | (F.length(inner) > 5)), before, inner

    full_ok, full_before, full_inner = last("（", "）", "（", "）")
    half_ok, half_before, half_inner = last("(", ")", r"\(", r"\)")
    return (
        F.when(full_ok, full_before).when(half_ok, half_before).otherwise(c),
        F.when(full_ok, full_inner).when(half_ok, half_inner),
    )
