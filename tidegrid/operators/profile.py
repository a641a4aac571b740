"""Value frequencies, column profile and row profile.

``value_counts`` is the one wide shuffle of an assessment: cells are grouped by
``(sheet, column, value)`` with map-side combine, so a value that fills a third
of a column travels once per task. Every predicate is then evaluated once per
distinct value and weighted by its count. Values longer than
``LONG_VALUE_BYTES`` are shuffled as a digest; their predicates are evaluated on
the whole text before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import cells as fx
from tidegrid.functions.dates import is_normal_date
from tidegrid.sheet import Sheets

LONG_VALUE_BYTES = 256
TIME_SAMPLE_ROWS = 100


def _if(guard: Column, then: Column) -> Column:
    """``then`` where a cheap necessary condition holds, so regexes run on few values."""
    return F.when(guard, then).otherwise(False)


def _facts(raw: Column) -> dict[str, Column]:
    v = fx.trim_ws(raw)
    digits_only = v.rlike("^-?[0-9]+([.][0-9]*)?$")
    datelike = fx.looks_like_date(v)
    date = _if(F.length(v).between(6, 10), fx.is_date(v))
    numeric = digits_only | fx.is_numeric_format(v)
    parse = digits_only & (F.length(v) < 300) | fx.is_num(raw)
    currency = v.rlike("^(NT[$]|USD|[$¥€])|[$¥€]$")
    bracket = fx.has_bracket(raw)
    return {
        "date": date,
        "num": ~date & numeric,
        "bool": _if(F.length(v) <= 5, fx.is_boolean(v)),
        "parse": parse,
        "numcur": parse | _if(currency, fx.is_numeric_currency(raw)),
        "ident": fx.is_identifier_like(raw),
        "remark": _if(bracket, fx.has_inline_remark(raw)),
        "note": _if(bracket, fx.has_cjk_bracket_note(raw)),
        "newline": fx.contains_newline(raw),
        "placeholder": _if(F.lower(F.left(v, F.lit(1))).isin("同", "s"), fx.is_placeholder(raw)),
        "datelike": datelike,
        # Every accepted layout has at least four digits and two separators.
        "normdate": _if(datelike, is_normal_date(raw)),
        "subtotal": _if(~digits_only, fx.is_subtotal_cell(raw)),
    }


FACTS = [
    "date", "num", "bool", "parse", "numcur", "ident", "remark", "note", "newline",
    "placeholder", "datelike", "normdate", "subtotal",
]
_BIT = {name: 1 << i for i, name in enumerate(FACTS)}


def fact_mask(raw: Column) -> Column:
    facts = _facts(raw)
    parts = [F.when(facts[n], F.lit(_BIT[n])).otherwise(0) for n in FACTS]
    return reduce(lambda a, b: a + b, parts)


def has(fact: str, mask: Column | None = None) -> Column:
    m = F.col("mask") if mask is None else mask
    if fact == "text":
        return m.bitwiseAND(_BIT["date"] | _BIT["num"] | _BIT["bool"]) == 0
    return m.bitwiseAND(_BIT[fact]) != 0


def value_cells(sheets: Sheets) -> DataFrame:
    """Cells as they are counted: long values as digests, with the facts of their whole texts."""
    raw = F.col("raw")
    is_long = F.octet_length(raw) > LONG_VALUE_BYTES
    return sheets.cells().select(
        "sheet_id", "row_idx", "col_idx",
        F.when(is_long, F.sha2(raw, 256)).otherwise(raw).alias("value"),
        # A one-element transform: evaluated for long values only and kept out
        # of the generated code of the scan.
        F.when(is_long, F.get(F.transform(F.array(raw), fact_mask), F.lit(0))).alias("long_mask"),
        F.when(is_long, F.length(raw)).alias("long_chars"),
    )


VALUE_CELL_KEYS = ["sheet_id", "col_idx", "value", "long_mask", "long_chars"]


def value_facts(counted: DataFrame, *measures: str) -> DataFrame:
    """Facts of each value of a grouping by ``VALUE_CELL_KEYS``."""
    short = F.col("long_mask").isNull()
    return counted.select(
        "sheet_id", "col_idx", "value", (~short).alias("is_long"), *measures,
        # No branch around the facts, because Spark shares their common parts only outside of branches;
        # the facts of a null are all off.
        F.coalesce("long_mask", F.lit(0)).bitwiseOR(fact_mask(F.when(short, F.col("value")))).alias("mask"),
        F.when(short, F.length("value")).otherwise(F.col("long_chars")).alias("n_chars"),
    )


def value_counts(sheets: Sheets) -> DataFrame:
    """sheet_id, col_idx, value, is_long, n, first_row, n_first100, mask, n_chars."""
    counted = value_cells(sheets).groupBy(*VALUE_CELL_KEYS).agg(
        F.count("*").alias("n"),
        F.min("row_idx").alias("first_row"),
        F.count_if(F.col("row_idx") < TIME_SAMPLE_ROWS).alias("n_first100"),
    )
    return value_facts(counted, "n", "first_row", "n_first100")


def first_seen_values(sheets: Sheets, values: DataFrame) -> DataFrame:
    """Distinct values with their first row; order by ``first_row`` for first-seen order.

    Long values travel as digests; their texts are fetched by their first row.
    """
    kept = ["sheet_id", "col_idx", "value", "n", "first_row"]
    long = values.filter("is_long").select(*kept).drop("value")
    cells = sheets.cells().select("sheet_id", "col_idx", F.col("row_idx").alias("first_row"), F.col("raw").alias("value"))
    fetched = long.join(cells, ["sheet_id", "col_idx", "first_row"]).select(*kept)
    return values.filter("not is_long").select(*kept).unionByName(fetched)


def row_counts(sheets: Sheets) -> DataFrame:
    return sheets.rows.groupBy("sheet_id").agg(F.count("*").alias("n_rows"))


def column_profile(sheets: Sheets, values: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row per sheet column; ``sizes`` is ``(sheet_id, n_rows, ..)``."""
    n = F.col("n")

    def weight(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(F.lit(0).cast("long")))

    text = has("text")
    chars = F.col("n_chars").cast("double")
    per_column = values.groupBy("sheet_id", "col_idx").agg(
        F.sum("n").alias("n_nonempty"),
        F.count("*").alias("n_distinct"),
        F.max("n").alias("max_freq"),
        *[weight(has(f)).alias(f"n_{f}") for f in FACTS],
        weight(text).alias("n_text"),
        F.sum(F.when(has("date"), F.col("n_first100")).otherwise(0)).alias("n_date_first100"),
        weight(has("date") | has("datelike")).alias("n_anydate"),
        F.sum(F.when(text, chars * n)).alias("sum_len"),
        F.sum(F.when(text, chars * chars * n)).alias("sum_len2"),
        F.max(~has("parse") & has("note")).alias("has_note_in_number"),
    )
    sizes = row_counts(sheets) if sizes is None else sizes
    shape = sheets.headers.join(sizes.select("sheet_id", "n_rows"), "sheet_id", "left")
    counts = [c for c in per_column.columns if c.startswith("n_") or c == "max_freq"]
    out = (
        shape.join(per_column, ["sheet_id", "col_idx"], "left")
        .na.fill(0, counts + ["n_rows"])
        .na.fill(False, ["has_note_in_number"])
    )
    mean = F.col("sum_len") / F.col("n_text")
    variance = F.greatest(F.col("sum_len2") / F.col("n_text") - mean * mean, F.lit(0.0))
    has_text = F.col("n_text") > 0
    return (
        out.withColumn("n_valid", F.col("n_nonempty") - F.col("n_placeholder"))
        .withColumn("len_avg", F.when(has_text, mean))
        .withColumn("len_std", F.when(has_text, F.sqrt(variance)))
        .drop("sum_len", "sum_len2")
    )


def share(part: str, whole: str = "n_nonempty") -> Column:
    """Ratio of two counts, 0 for an empty denominator."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def column_flags(profile: DataFrame) -> DataFrame:
    """Column classifications the indicators, issues and rules decide on."""
    c = F.col
    numcur = share("n_numcur")
    dominant = F.greatest("n_date", "n_num", "n_bool", "n_text")
    note = share("n_note")
    return profile.select(
        "*",
        F.when(c("n_rows") > 0, c("n_valid") / c("n_rows")).otherwise(0.0).alias("valid_ratio"),
        F.when(c("n_rows") > 0, c("n_nonempty") / c("n_rows")).otherwise(0.0).alias("fill_ratio"),
        F.when(c("n_nonempty") > 0, dominant / c("n_nonempty")).alias("consistency"),
        F.when(c("n_date") == dominant, "DATE").when(c("n_num") == dominant, "NUMERIC")
        .when(c("n_bool") == dominant, "BOOLEAN").otherwise("TEXT").alias("dominant_type"),
        (share("n_distinct") > 0.8).alias("is_identifier"),
        F.coalesce(
            F.try_divide(c("n_date_first100"), F.least(c("n_rows"), F.lit(TIME_SAMPLE_ROWS))) > 0.6, F.lit(False)
        ).alias("is_time"),
        ((c("n_distinct") > 1) & (c("n_distinct") < c("n_rows") * 0.2)).alias("is_category"),
        (share("n_parse") > 0.8).alias("is_numeric"),
        (share("n_parse") > 0.7).alias("is_numeric_for_placeholder"),
        (numcur > 0.7).alias("is_mostly_numeric"),
        F.when(numcur > 0.7, c("n_nonempty") - c("n_numcur")).otherwise(0).alias("n_mismatch"),
        (share("n_ident") > 0.6).alias("is_structured"),
        ((share("n_ident") > 0.6) & (share("n_remark") > 0.2)).alias("is_remark_dense"),
        (share("n_anydate") > 0.3).alias("is_date_display"),
        (share("n_normdate") > 0.5).alias("is_date_cleaning"),
        ((c("n_nonempty") > 0) & (share("n_parse") < 0.5)).alias("is_text_cleaning"),
        ((c("n_nonempty") > 5) & (share("n_newline") > 0.1)).alias("is_newline_heavy"),
        (
            ((share("n_text") >= 0.5) & (c("n_text") > 0) & (c("len_std") > c("len_avg") * 3))
            | ((share("n_parse") > 0.6) & c("has_note_in_number"))
            | ((c("n_nonempty") > 10) & (note > 0.1) & (note < 0.8))
        ).alias("has_notes"),
        (
            (c("n_nonempty") > 0)
            & (share("n_text") >= 0.3)
            & (share("n_date") <= 0.5)
            & (share("n_datelike") <= 0.5)
            & (F.try_divide("max_freq", "n_rows") <= 0.05)
            & (c("n_distinct") > 10)
            & (share("n_distinct") <= 0.8)
            & (F.try_divide("n_distinct", "n_rows") > 0.01)
            & (F.try_divide("n_distinct", "n_rows") < 0.95)
        ).alias("is_near_dup_candidate"),
    )


def _in_shape(sheets: Sheets) -> list[Column]:
    return [F.col("n_cols") > i for i in range(sheets.width)]


def row_facts(sheets: Sheets, keep_cells: bool = False) -> DataFrame:
    """sheet_id, row_idx, n_cols, n_filled and a digest of the row's cells; with ``keep_cells`` the cells too."""
    cells = sheets.cell_columns
    shaped = sheets.rows.join(sheets.shapes().select("sheet_id", "n_cols"), "sheet_id")
    pieces = [
        F.when(inside, F.concat(F.coalesce(c, F.lit("")), F.lit("|"))).otherwise("")
        for c, inside in zip(cells, _in_shape(sheets))
    ]
    return shaped.select(
        "sheet_id", "row_idx", "n_cols",
        fx.count_true([~fx.is_empty(c) for c in cells]).alias("n_filled"),
        F.unhex(F.sha2(F.concat(*pieces), 256)).alias("row_key"),
        *(sheets.cell_names if keep_cells else []),
    )


def row_summary(facts: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """One row per sheet: sizes, fill classes and exact duplicates.

    With ``shapes`` (sheet_id, n_cols) sheets without rows are there too, with
    zero counts. Rows are pre-grouped by digest with map-side combine, so a row copied a
    billion times is one record per task.
    """
    return summary_of_groups(row_groups(facts), shapes)


def row_groups(facts: DataFrame) -> DataFrame:
    """Equal rows counted: sheet_id, row_key (null for blank rows), n_cols, n_filled, n, lo, hi."""
    key = F.when(F.col("n_filled") > 0, F.col("row_key"))
    return facts.groupBy("sheet_id", key.alias("row_key"), "n_cols", "n_filled").agg(
        F.count("*").alias("n"), F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi")
    )


def summary_of_groups(groups: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """``row_summary`` from the counts of equal rows."""
    blank = F.col("n_filled") == 0
    fill = F.col("n_filled") / F.col("n_cols")
    n = F.col("n")
    found = groups.groupBy("sheet_id").agg(
        F.max("n_cols").alias("n_cols"),
        F.min(F.when(~blank, F.col("lo"))).alias("first_data"),
        F.max(F.when(~blank, F.col("hi"))).alias("last_data"),
        F.sum("n").alias("n_rows"),
        F.sum(F.when(fill >= 0.8, n).otherwise(0)).alias("high"),
        F.sum(F.when((fill >= 0.5) & (fill < 0.8), n).otherwise(0)).alias("medium"),
        F.sum(F.when(fill < 0.5, n).otherwise(0)).alias("low"),
        F.sum(F.when(F.col("n_filled") < F.col("n_cols"), n).otherwise(0)).alias("n_incomplete"),
        F.sum(F.when(blank, n).otherwise(0)).alias("n_blank"),
        F.sum(n - 1).alias("n_exact_duplicates"),
        F.sum(F.col("n_filled") * n).alias("n_filled_cells"),
    )
    if shapes is None:
        return found
    counts = [c for c in found.columns if c not in ("sheet_id", "n_cols", "first_data", "last_data")]
    every = shapes.select("sheet_id", F.col("n_cols").alias("__n_cols"))
    return every.join(found, "sheet_id", "left").na.fill(0, counts).withColumn(
        "n_cols", F.coalesce("n_cols", "__n_cols")
    ).select(*found.columns)


def header_distribution(sheets: Sheets) -> DataFrame:
    """Fill classes of the rows above the data (pre-header rows and the header row)."""
    names = sheets.headers.groupBy("sheet_id").agg(
        F.count("*").alias("n_cols"),
        F.count_if(~fx.is_empty(F.col("name"))).alias("n_filled"),
    )
    if sheets.leading is None:
        above = names
    else:
        # leading: sheet_id, row_no, cells (null when the raw row was not kept)
        width = names.select("sheet_id", "n_cols")
        above = sheets.leading.join(width, "sheet_id").select(
            "sheet_id", "n_cols",
            F.coalesce(
                F.size(F.filter("cells", lambda x: ~fx.is_empty(x))), F.lit(0)
            ).alias("n_filled"),
        )
    fill = F.col("n_filled") / F.col("n_cols")
    return above.groupBy("sheet_id").agg(
        F.count_if(fill >= 0.8).alias("high"),
        F.count_if((fill >= 0.5) & (fill < 0.8)).alias("medium"),
        F.count_if(fill < 0.5).alias("low"),
    )


def row_distribution(sheets: Sheets, summary: DataFrame) -> DataFrame:
    both = summary.select("sheet_id", "high", "medium", "low").unionByName(
        header_distribution(sheets)
    )
    return both.groupBy("sheet_id").agg(*[F.sum(c).alias(c) for c in ("high", "medium", "low")])


def mentioned_columns(headers: DataFrame, question: str) -> DataFrame:
    """Header rows whose name occurs in the question (PRD: trimmed, lower case, not blank)."""
    name = F.lower(fx.trim_ws(F.col("name")))
    return headers.filter((name != "") & F.contains(F.lit(question.lower()), name))


def company_column(headers: DataFrame) -> DataFrame:
    """First column per sheet whose header names a company."""
    from tidegrid import lexicon as lx

    return (
        headers.filter(fx.has_word(F.col("name"), lx.COMPANY_HEADER_WORDS))
        .groupBy("sheet_id")
        .agg(F.min("col_idx").alias("col_idx"))
    )


def header_quality(headers: DataFrame) -> DataFrame:
    """sheet_id, good_names, has_empty_header."""
    name = F.lower(fx.trim_ws(F.col("name")))
    return headers.groupBy("sheet_id").agg(
        (F.min(F.length(name) > 1) & (F.count_distinct(name) == F.count("*"))).alias("good_names"),
        F.max(fx.is_empty(F.col("name"))).alias("has_empty_header"),
    )


def residual_cjk(sheets: Sheets, limit: int = 80, width: int = 80) -> DataFrame:
    """The first ``limit`` cells in reading order that still hold CJK text, cut to ``width``."""
    return (
        sheets.cells()
        .filter(fx.has_residual_cjk(F.col("raw")))
        .orderBy("sheet_id", "row_idx", "col_idx")
        .limit(limit)
        .select("sheet_id", "row_idx", "col_idx", F.left("raw", F.lit(width)).alias("raw"))
    )
