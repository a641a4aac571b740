"""Registered queries: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.functions import cells as fx
from tidegrid.operators import anonymize as an
from tidegrid.operators import cleaning as cl
from tidegrid.operators import compare as cp
from tidegrid.operators import duplicates as du
from tidegrid.operators import edits as ed
from tidegrid.operators import entities as en
from tidegrid.operators import fingerprint as fp
from tidegrid.operators import gate
from tidegrid.operators import indicators as ind
from tidegrid.operators import issues as iss
from tidegrid.operators import lookup as lk
from tidegrid.operators import profile as pf
from tidegrid.operators import reports as rp
from tidegrid.operators import structure as st
from tidegrid.operators import usage as us
from tidegrid.operators.keyed_table import keyed_table
from tidegrid.operators.sketches import ERROR_BOUND, SketchStore
from tidegrid.plans.assess import assess
from tidegrid.plans.clean import clean
from tidegrid.plans.rescore import rescore, score_state
from tidegrid.plans.session import cleaning_session as run_session
from tidegrid.session import materialize, shared_folder
from tidegrid.sheet import Sheets, header_table, union_sheets
from tidegrid.sources import csv as csvio
from tidegrid.sources import grid as gr
from workloads import oracle_sql as o
from workloads.dirty import SHEETS, dirty_sheet, ingested, load

REGISTRY: dict[str, tuple] = {}
ALL = tuple(SHEETS)


def register(sql: str | None = None):
    def add(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn
    return add


def sheets(spark: SparkSession, d: str, *names: str) -> Sheets:
    return union_sheets([dirty_sheet(spark, d, n) for n in names])


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def flagged_columns(s: Sheets) -> DataFrame:
    return pf.column_flags(pf.column_profile(s, pf.value_counts(s)))


def base_sql(*names: str) -> str:
    return f"{o.sheets_cte(*names)}, {o.cells_cte(o.width_of(*names))}, {o.facts_cte()}"


def profile_sql(*names: str) -> str:
    return f"{base_sql(*names)}, {o.profile_cte()}"


def scored_sql(*names: str) -> str:
    w = o.width_of(*names)
    return f"{profile_sql(*names)}, {o.rows_cte(w)}, {o.near_cte()}, {o.scores_cte(w)}"


# Profile ------------------------------------------------------------------

PROFILE_COUNTS = [
    "n_rows", "n_nonempty", "n_valid", "n_distinct", "max_freq", "n_date", "n_num", "n_bool", "n_text",
    "n_parse", "n_numcur", "n_ident", "n_remark", "n_note", "n_newline", "n_placeholder",
    "n_datelike", "n_normdate", "n_subtotal", "n_date_first100", "n_mismatch",
]
PROFILE_FLAGS = [
    "is_identifier", "is_time", "is_category", "is_numeric", "is_mostly_numeric", "is_structured",
    "is_remark_dense", "is_date_display", "is_date_cleaning", "is_text_cleaning",
    "is_newline_heavy", "has_notes", "is_near_dup_candidate",
]
PROFILE_SQL = (
    f"SELECT sheet_id, col_idx, name, {', '.join(PROFILE_COUNTS + PROFILE_FLAGS)}, "
    "round(valid_ratio, 6) AS valid_ratio, round(fill_ratio, 6) AS fill_ratio, "
    "round(consistency, 6) AS consistency, round(len_avg, 6) AS len_avg, round(len_std, 4) AS len_std FROM flags"
)


def profile_columns(flagged: DataFrame) -> DataFrame:
    return flagged.select(
        "sheet_id", "col_idx", "name", *PROFILE_COUNTS, *PROFILE_FLAGS,
        r6("valid_ratio"), r6("fill_ratio"), r6("consistency"), r6("len_avg"),
        F.round("len_std", 4).alias("len_std"),
    )


@register(f"{profile_sql(*ALL)} {PROFILE_SQL}")
def column_profile(spark, d):
    return profile_columns(flagged_columns(sheets(spark, d, *ALL)))


LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def lineitem_sheet(spark, d) -> Sheets:
    from tidegrid.operators.positions import number_parquet_rows
    from tidegrid.sheet import sheets_from_table

    numbered = number_parquet_rows(load(spark, d, "lineitem").select(*LINEITEM_COLUMNS))
    return sheets_from_table(numbered, "lineitem", LINEITEM_COLUMNS, "row_idx")


def _lineitem_cells() -> str:
    money = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}
    parts = []
    for i, c in enumerate(LINEITEM_COLUMNS):
        text = f"CAST({c} AS DECIMAL(18,2))" if c in money else c
        text = f"CAST({c} AS DATE)" if c == "l_shipdate" else text
        parts.append(f"CAST({text} AS VARCHAR) AS c{i}")
    heads = ", ".join(f"('lineitem', {i}, '{c}')" for i, c in enumerate(LINEITEM_COLUMNS))
    return (
        "WITH sheet AS (SELECT 'lineitem' AS sheet_id, row_number() OVER () - 1 AS row_idx, "
        f"{', '.join(parts)} FROM lineitem), headers(sheet_id, col_idx, name) AS (VALUES {heads}), "
        "shape AS (SELECT sheet_id, count(*) AS n_cols FROM headers GROUP BY 1), "
        "sizes AS (SELECT sheet_id, count(*) AS n_rows FROM sheet GROUP BY 1), "
        f"{o.cells_cte(11)}, {o.facts_cte()}, {o.profile_cte()}"
    )


@register(f"{_lineitem_cells()} {PROFILE_SQL}")
def column_profile_lineitem(spark, d):
    return profile_columns(flagged_columns(lineitem_sheet(spark, d)))


@register(
    f"{base_sql('orders', 'customers')} SELECT sheet_id, col_idx, raw AS value, count(*) AS n, min(row_idx) AS first_row, "
    + ", ".join(f"any_value(is_{k}) AS is_{k}" for k in pf.FACTS if k not in ("num", "bool"))
    + ", any_value(fmt) AS fmt FROM facts GROUP BY ALL"
)
def cell_predicates(spark, d):
    v = pf.value_counts(sheets(spark, d, "orders", "customers"))
    fmt = F.when(pf.has("date"), "DATE").when(pf.has("num"), "NUMERIC").when(pf.has("bool"), "BOOLEAN").otherwise("TEXT")
    return v.select(
        "sheet_id", "col_idx", "value", "n", "first_row",
        *[pf.has(k).alias(f"is_{k}") for k in pf.FACTS if k not in ("num", "bool")], fmt.alias("fmt"),
    )


@register(
    f"{base_sql('orders', 'events')} SELECT sheet_id, col_idx, fmt, CASE fmt WHEN 'DATE' THEN '日期' "
    "WHEN 'NUMERIC' THEN '數字' WHEN 'BOOLEAN' THEN '布林' ELSE '文字' END AS label, count(*) AS n FROM facts GROUP BY ALL"
)
def format_types(spark, d):
    fmt = fx.format_type(F.col("raw"))
    return sheets(spark, d, "orders", "events").cells().groupBy("sheet_id", "col_idx", fmt.alias("fmt")).agg(
        F.count("*").alias("n")
    ).withColumn("label", fx.format_label(F.col("fmt")))


ROWS_SQL = f"{o.sheets_cte(*ALL)}, {o.rows_cte(o.width_of(*ALL))}"


@register(
    f"{ROWS_SQL} SELECT sheet_id, count(*) AS n_rows, count(*) FILTER (WHERE n_filled / n_cols >= 0.8) AS high, "
    "count(*) FILTER (WHERE n_filled / n_cols >= 0.5 AND n_filled / n_cols < 0.8) AS medium, "
    "count(*) FILTER (WHERE n_filled / n_cols < 0.5) AS low, count(*) FILTER (WHERE n_filled < n_cols) AS n_incomplete, "
    "count(*) FILTER (WHERE n_filled = 0) AS n_blank, "
    "(count(*) - count(DISTINCT CASE WHEN n_filled = 0 THEN '' ELSE row_text END))::BIGINT AS n_exact_duplicates, "
    "sum(n_filled)::BIGINT AS n_filled_cells, round(sum(n_filled) / sum(n_cols), 6) AS fill FROM fill GROUP BY 1"
)
def row_summary(spark, d):
    s = pf.row_summary(pf.row_facts(sheets(spark, d, *ALL)))
    return s.select(
        "sheet_id", "n_rows", "high", "medium", "low", "n_incomplete", "n_blank",
        "n_exact_duplicates", "n_filled_cells",
        F.round(F.col("n_filled_cells") / (F.col("n_rows") * F.col("n_cols")), 6).alias("fill"),
    )


# Structure ----------------------------------------------------------------

@register(
    f"{o.sheets_cte('orders', 'customers')}, {o.rows_cte(9)} SELECT sheet_id, n_rows, first_data, last_data, post_gap, "
    "has_multiple_tables FROM gapsum"
)
def table_gaps(spark, d):
    return st.gap_summary(st.filled_counts(sheets(spark, d, "orders", "customers")))


BLOCKS_SQL = f"""{o.sheets_cte('orders')}, {o.rows_cte(9)},
starts AS (SELECT sheet_id, first_data AS s FROM bounds UNION
  SELECT g.sheet_id, gap_end + 1 FROM gaps g JOIN bounds USING (sheet_id) WHERE gap_end + 1 <= last_data AND gap_end >= first_data),
blocks AS (SELECT s.sheet_id, s AS start_row, coalesce(min(gap_start), any_value(n_rows)) AS end_row
  FROM starts s JOIN bounds b USING (sheet_id) LEFT JOIN gaps g ON g.sheet_id = s.sheet_id AND g.gap_start > s.s GROUP BY 1, 2),
ranked AS (SELECT *, end_row - start_row AS size, row_number() OVER (PARTITION BY sheet_id ORDER BY start_row) - 1 AS block_idx,
  row_number() OVER (PARTITION BY sheet_id ORDER BY end_row - start_row DESC, start_row) = 1 AS is_main FROM blocks)"""


@register(f"{BLOCKS_SQL} SELECT sheet_id, block_idx::INT AS block_idx, start_row, end_row, size, is_main FROM ranked")
def data_blocks(spark, d):
    return st.data_blocks(st.filled_counts(sheets(spark, d, "orders"))).drop("n_blocks")


@register(
    f"{base_sql('orders')}, {o.rows_cte(9)} SELECT f.sheet_id, f.row_idx, f.n_filled FROM fill f JOIN gapsum g USING (sheet_id) "
    "WHERE f.n_filled BETWEEN 1 AND 2 AND f.row_idx >= g.post_gap AND EXISTS "
    "(SELECT 1 FROM facts x WHERE x.sheet_id = f.sheet_id AND x.row_idx = f.row_idx AND x.is_parse)"
)
def orphan_totals(spark, d):
    s = sheets(spark, d, "orders")
    sparse = st.sparse_rows(s)
    return st.orphan_rows(sparse, st.gap_summary(st.filled_counts(s))).select("sheet_id", "row_idx", "n_filled")


@register(
    f"{scored_sql(*ALL)}, comp AS (SELECT sheet_id, min(col_idx) AS company_col FROM headers WHERE "
    "regexp_matches(lower(name), '客戶|公司|廠商|client|company|vendor|supplier|customer') GROUP BY 1) "
    "SELECT h.sheet_id, good AS good_names, blank_head AS has_empty_header, coalesce(m.has_multi_header, false) AS has_multi_header, "
    "company_col::INT AS company_col FROM heads h LEFT JOIN multi m USING (sheet_id) LEFT JOIN comp USING (sheet_id)"
)
def header_checks(spark, d):
    s = sheets(spark, d, *ALL)
    company = pf.company_column(s.headers).withColumnRenamed("col_idx", "company_col")
    return (
        pf.header_quality(s.headers).join(st.multi_layer_headers(s.rows), "sheet_id", "left")
        .na.fill(False, ["has_multi_header"]).join(company, "sheet_id", "left")
    )


@register(
    f"{profile_sql('orders', 'customers', 'documents')}, hits AS (SELECT f.sheet_id, col_idx, row_idx, "
    "CASE WHEN NOT p.is_date_display AND f.is_newline AND f.is_note THEN 1 WHEN NOT p.is_date_display AND f.is_note THEN 2 "
    "WHEN NOT p.is_date_display AND f.is_newline THEN 3 WHEN p.n_parse / p.n_nonempty > 0.6 AND f.is_note AND NOT f.is_parse THEN 4 END AS priority "
    "FROM facts f JOIN flags p USING (sheet_id, col_idx)) SELECT sheet_id, priority::INT AS priority, col_idx, row_idx FROM hits "
    "WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY priority, col_idx, row_idx) = 1"
)
def note_location(spark, d):
    s = sheets(spark, d, "orders", "customers", "documents")
    return st.note_location(s, materialize(flagged_columns(s)))


@register(
    f"{o.sheets_cte('orders', 'customers')}, {o.cells_cte(9)} SELECT sheet_id, row_idx, col_idx, left(raw, 80) AS raw FROM cells "
    "WHERE regexp_matches(raw, '[一-鿿㐀-䶿]') ORDER BY sheet_id, row_idx, col_idx LIMIT 80"
)
def residual_cjk(spark, d):
    return pf.residual_cjk(sheets(spark, d, "orders", "customers"))


# Duplicates and entities --------------------------------------------------

@register(
    f"{o.sheets_cte('orders')}, {o.rows_cte(9)}, g AS (SELECT row_idx, row_number() OVER (PARTITION BY row_text ORDER BY row_idx) AS nth, "
    "min(row_idx) OVER (PARTITION BY row_text) AS first_row, count(*) OVER (PARTITION BY row_text) AS n FROM fill "
    "WHERE (n_cols - n_filled) / n_cols <= 0.7) SELECT 'orders' AS sheet_id, "
    "(row_number() OVER (ORDER BY first_row, row_idx))::INT AS pos, row_idx FROM g WHERE n > 1 AND nth <= 2 ORDER BY pos LIMIT 5"
)
def exact_duplicate_examples(spark, d):
    s = sheets(spark, d, "orders")
    return du.exact_duplicate_examples(pf.row_facts(s))


@register(
    f"{profile_sql('orders', 'customers', 'parts')}, {o.near_cte()} SELECT sheet_id, col_idx, rank1::INT AS rank1, rank2::INT AS rank2, "
    "value1, value2, row1, row2 FROM pairs"
)
def near_duplicates(spark, d):
    s = sheets(spark, d, "orders", "customers", "parts")
    values = materialize(pf.value_counts(s))
    flagged = materialize(pf.column_flags(pf.column_profile(s, values)))
    return du.near_pairs(du.near_values(s, values, du.near_candidates(flagged)))


@register(
    f"{profile_sql('orders', 'customers', 'parts')}, {o.all_near_cte()}, sides AS (SELECT sheet_id, col_idx, row1 AS first_row, "
    "row2 AS other FROM allpairs UNION ALL SELECT sheet_id, col_idx, row2, row1 FROM allpairs) SELECT sheet_id, col_idx, "
    "any_value(raw) AS value, first_row, count(*) AS n_near, min(other) AS first_near FROM sides JOIN allvals "
    "USING (sheet_id, col_idx, first_row) GROUP BY sheet_id, col_idx, first_row"
)
def near_duplicates_full(spark, d):
    """Without the limits of the scoring rule: every value of every eligible column, with its near ones counted."""
    s = sheets(spark, d, "orders", "customers", "parts")
    values = materialize(pf.value_counts(s))
    chosen = du.all_near_values(s, values, pf.column_flags(pf.column_profile(s, values)))
    return du.near_neighbours(chosen, du.all_near_pairs(chosen))


NAMES_SQL = (
    f"{o.sheets_cte('orders', 'customers')}, {o.cells_cte(9)}, spelled AS (SELECT sheet_id, col_idx, "
    f"replace(v, chr(10), ' ') AS spelling, {o.entity_key('replace(v, chr(10), chr(32))')} AS key, count(*) AS n, min(row_idx) AS first_row "
    "FROM cells WHERE col_idx = 1 GROUP BY ALL)"
)


@register(
    f"{NAMES_SQL} SELECT sheet_id, col_idx, key, count(*) AS n_variants, max(n) AS canonical_count, "
    "arg_max(spelling, n * 1000000000 - first_row) AS canonical, sum(n)::BIGINT AS total_rows, min(first_row) AS first_row "
    "FROM spelled GROUP BY ALL HAVING count(*) > 1"
)
def name_variants(spark, d):
    s = sheets(spark, d, "orders", "customers")
    return en.variant_groups(en.spellings(s, pf.company_column(s.headers)))


# Cleaning rules -----------------------------------------------------------

ORDER_CELLS = [f"c{i}" for i in range(9)]
CUSTOMER_CELLS = [f"c{i}" for i in range(4)]


def clean_rows(sql_cells: dict[int, str], where: str = "true", name: str = "orders", renumber: bool = False) -> str:
    """SELECT of the sheet with some cells rewritten and rows filtered."""
    width = o.width_of(name)
    cells = ", ".join(f"{sql_cells.get(i, f'c{i}')} AS c{i}" for i in range(width))
    index = "row_number() OVER (ORDER BY row_idx) - 1" if renumber else "row_idx"
    return f"SELECT '{name}' AS sheet_id, {index} AS row_idx, {cells} FROM sheet WHERE {where}"


def nonblank(x: str) -> str:
    return f"coalesce({o.trim(x)}, '') <> ''"


def rule(spark, d, fn, name="orders", **kw):
    return fn(sheets(spark, d, name), **kw)[0].rows


_norm = o.normal_date(o.trim("c3"))


@register(f"{o.sheets_cte('orders')} " + clean_rows({3: f"coalesce({_norm}, c3)"}))
def clean_date_normalize(spark, d):
    return rule(spark, d, cl.date_normalize)


_text = " || ".join(f"coalesce({c}, '') || '|'" for c in ORDER_CELLS)
DEDUP_WHERE = "row_idx IN (SELECT min(row_idx) FROM sheet GROUP BY {t})"


@register(f"{o.sheets_cte('orders')} " + clean_rows({}, DEDUP_WHERE.format(t=_text), renumber=True))
def clean_dedup(spark, d):
    return rule(spark, d, cl.dedup)


@register(
    "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, text AS c0 FROM (SELECT * FROM documents "
    "QUALIFY doc_id = min(doc_id) OVER (PARTITION BY text))"
)
def dedup_documents(spark, d):
    from tidegrid.sheet import sheets_from_table

    s = sheets_from_table(load(spark, d, "documents").withColumn("pos", F.col("doc_id")), "documents", ["text"], "pos")
    return cl.dedup(s)[0].rows.select("row_idx", "c0")


_map = (
    "canon AS (SELECT key, arg_max(spelling, n * 1000000000 - first_row) AS canonical FROM spelled "
    "WHERE sheet_id = 'customers' GROUP BY 1 HAVING count(*) > 1)"
)


@register(
    f"{o.sheets_cte('customers')}, {o.cells_cte(4)}, spelled AS (SELECT sheet_id, v AS spelling, {o.entity_key('v')} AS key, "
    f"count(*) AS n, min(row_idx) AS first_row FROM cells WHERE col_idx = 1 GROUP BY ALL), {_map} "
    "SELECT s.sheet_id, row_idx, c0, CASE WHEN canonical IS NOT NULL AND canonical <> spelling THEN canonical ELSE c1 END AS c1, c2, c3 "
    f"FROM sheet s LEFT JOIN spelled p ON {o.trim('s.c1')} = p.spelling LEFT JOIN canon USING (key)"
)
def clean_name_normalize(spark, d):
    return rule(spark, d, cl.name_normalize, "customers")


_subtotal = " OR ".join(f"coalesce({o.is_subtotal(c)}, false)" for c in ORDER_CELLS)
_blank = " AND ".join(f"coalesce({o.trim(c)}, '') = ''" for c in ORDER_CELLS)


@register(f"{o.sheets_cte('orders')} " + clean_rows({}, f"NOT ({_subtotal})", renumber=True))
def clean_subtotal_remove(spark, d):
    return rule(spark, d, cl.subtotal_remove)


@register(f"{o.sheets_cte('orders')} " + clean_rows({}, f"NOT ({_blank})", renumber=True))
def clean_empty_row_remove(spark, d):
    return rule(spark, d, cl.empty_row_remove)


@register(f"{o.sheets_cte('orders')} " + clean_rows({6: "replace(c6, chr(10), ' ')"}))
def clean_newline_remove(spark, d):
    return rule(spark, d, cl.newline_remove)


def _unnote(x: str) -> str:
    for _ in range(4):
        x = rf"regexp_replace({x}, '^([^(]*)\([^)]*[一-鿿][^)]*\)', '\1')"
        x = rf"regexp_replace({x}, '^([^（]*)（[^）]*[一-鿿][^）]*）', '\1')"
    return o.trim(x)


@register(
    f"{o.sheets_cte('orders')} "
    + clean_rows({i: f"CASE WHEN {nonblank(f'c{i}')} THEN {_unnote(f'c{i}')} ELSE c{i} END" for i in range(9)})
)
def clean_bracket_note_remove(spark, d):
    return rule(spark, d, cl.bracket_note_remove)


@register(
    f"{o.sheets_cte('orders')} SELECT sheet_id, row_idx, c0, c1, c2, c3, c4, c5, c7 AS c6, c8 AS c7 FROM sheet"
)
def clean_empty_col_remove(spark, d):
    return rule(spark, d, cl.empty_col_remove)


@register(
    f"{BLOCKS_SQL} SELECT s.sheet_id, s.row_idx - start_row AS row_idx, {', '.join(ORDER_CELLS)} FROM sheet s "
    "JOIN ranked ON is_main AND s.row_idx >= start_row AND s.row_idx < end_row"
)
def clean_multi_table_keep_main(spark, d):
    return rule(spark, d, cl.multi_table_keep)


@register(
    f"{BLOCKS_SQL} SELECT s.sheet_id, s.row_idx - start_row AS row_idx, {', '.join(ORDER_CELLS)} FROM sheet s "
    "JOIN ranked ON block_idx = 1 AND s.row_idx >= start_row AND s.row_idx < end_row"
)
def clean_multi_table_keep_block(spark, d):
    return rule(spark, d, cl.multi_table_keep, keep_block=1)


def row_ops(spark, d, remainder: int, action: str) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, d, "orders").filter(k % 100 == remainder).select(
        F.lit("orders").alias("sheet_id"), k.alias("row_idx"), F.lit(action).alias("action")
    )


@register(
    f"{o.sheets_cte('orders')} "
    + clean_rows({i: f"CASE WHEN row_idx % 100 = 1 AND NOT ({nonblank(f'c{i}')}) THEN 'N/A' ELSE c{i} END" for i in range(9)})
)
def clean_fill_na(spark, d):
    return cl.fill_na(sheets(spark, d, "orders"), row_ops(spark, d, 1, "fill_na"))[0].rows


@register(f"{o.sheets_cte('orders')} " + clean_rows({}, "row_idx % 100 <> 2", renumber=True))
def clean_delete_rows(spark, d):
    return cl.delete_rows(sheets(spark, d, "orders"), row_ops(spark, d, 2, "delete"))[0].rows


PIPELINE = ["subtotal_remove", "empty_row_remove", "newline_remove", "date_normalize", "dedup"]
PIPELINE_SQL = (
    f"{o.sheets_cte('orders')}, s1 AS (SELECT * REPLACE (row_number() OVER (ORDER BY row_idx) - 1 AS row_idx) FROM sheet WHERE NOT ({_subtotal})), "
    f"s2 AS (SELECT * REPLACE (row_number() OVER (ORDER BY row_idx) - 1 AS row_idx) FROM s1 WHERE NOT ({_blank})), "
    f"s3 AS (SELECT * REPLACE (replace(c6, chr(10), ' ') AS c6, coalesce({_norm}, c3) AS c3) FROM s2), "
    f"s4 AS (SELECT * REPLACE (row_number() OVER (ORDER BY row_idx) - 1 AS row_idx) FROM s3 WHERE row_idx IN (SELECT min(row_idx) FROM s3 GROUP BY {_text})), "
    "s5 AS (SELECT * REPLACE ("
    + ", ".join(f"CASE WHEN row_idx % 100 = 1 AND NOT ({nonblank(c)}) THEN 'N/A' ELSE {c} END AS {c}" for c in ORDER_CELLS)
    + ") FROM s4)"
)


SESSION_TIME = "2024-01-01 08:00:00"


def cleaned_orders(spark, d):
    ops = row_ops(spark, d, 1, "fill_na").unionByName(row_ops(spark, d, 2, "delete"))
    return clean(sheets(spark, d, "orders"), PIPELINE, row_ops=ops)


@register(
    f"{PIPELINE_SQL} SELECT sheet_id, row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, {', '.join(ORDER_CELLS)} "
    "FROM s5 WHERE row_idx % 100 <> 2"
)
def clean_pipeline(spark, d):
    return cleaned_orders(spark, d).sheets.rows


@register(
    f"{PIPELINE_SQL}, log AS ("
    f"SELECT 0 AS seq, 'subtotal_remove' AS operation_type, (SELECT count(*) FROM sheet) - (SELECT count(*) FROM s1) AS n_rows, '移除 %d 筆小計/合計列' AS t "
    "UNION ALL SELECT 1, 'empty_row_remove', (SELECT count(*) FROM s1) - (SELECT count(*) FROM s2), '移除 %d 筆全空資料列' "
    "UNION ALL SELECT 2, 'newline_remove', (SELECT count(*) FROM s2 WHERE contains(c6, chr(10))), '移除 %d 列中的儲存格內換行' "
    f"UNION ALL SELECT 3, 'date_normalize', (SELECT count(*) FROM s2 WHERE {_norm} <> c3), '統一欄位 3 的日期格式為 YYYY/MM/DD' "
    "UNION ALL SELECT 4, 'dedup', (SELECT count(*) FROM s3) - (SELECT count(*) FROM s4), '移除 %d 筆完全重複的資料列') "
    "SELECT seq::INT AS seq, operation_type, n_rows, replace(t, '%d', n_rows::VARCHAR) AS details FROM log"
)
def audit_entries(spark, d):
    return cleaned_orders(spark, d).entries().filter("seq < 5").select("seq", "operation_type", "n_rows", "details")


@register(
    f"{o.sheets_cte('orders')}, hit AS (SELECT row_idx, row_number() OVER (ORDER BY row_idx) AS rn FROM sheet WHERE {_subtotal}), n AS (SELECT count(*) AS n FROM hit) "
    "SELECT ((rn - 1) // 10000)::BIGINT AS part, '[2024-01-01 08:00:00] 移除小計列：第 ' || string_agg(row_idx::VARCHAR, ', ' ORDER BY row_idx) "
    "|| ' 列 — 移除 ' || any_value(n)::VARCHAR || ' 筆小計/合計列' AS line FROM hit, n GROUP BY 1"
)
def audit_log_lines(spark, d):
    log = cl.subtotal_remove(sheets(spark, d, "orders"))[1].withColumn("seq", F.lit(0))
    return rp.log_lines(materialize(log), F.lit("2024-01-01 08:00:00").cast("timestamp")).select("part", "line")


@register(
    f"{o.sheets_cte('orders', 'events')} SELECT h.sheet_id, h.col_idx, CASE WHEN name = '' THEN '第' || (col_idx + 1) || '欄' ELSE name END AS col_name, "
    "round(rate, 6) AS empty_rate, rate > 0.8 AS is_removable FROM headers h JOIN ("
    + " UNION ALL ".join(
        f"SELECT sheet_id, {i} AS col_idx, count(*) FILTER (WHERE NOT ({nonblank(f'c{i}')})) / count(*) AS rate FROM sheet GROUP BY 1"
        for i in range(9)
    )
    + ") USING (sheet_id, col_idx)"
)
def removal_preview_columns(spark, d):
    t = cl.removal_preview(sheets(spark, d, "orders", "events"))["columns"]
    return t.select("sheet_id", "col_idx", "col_name", r6("empty_rate"), "is_removable")


@register(
    f"{BLOCKS_SQL} SELECT r.sheet_id, block_idx::INT AS block_idx, start_row + 1 AS start_row, end_row, size AS row_count, is_main, "
    "left(array_to_string(list_filter([" + ", ".join(f"s.c{i}" for i in range(9)) + "], "
    "lambda x: coalesce(trim(x), '') <> '')[1:3], ' | '), 200) AS preview FROM ranked r JOIN sheet s ON s.row_idx = r.start_row"
)
def removal_preview_blocks(spark, d):
    return cl.removal_preview(sheets(spark, d, "orders"))["blocks"]


# Edits --------------------------------------------------------------------

EDITS_SQL = """
SELECT CAST(o_orderkey * 10 AS BIGINT) AS edit_no, 'orders' AS sheet_id, o_orderkey AS row_idx, 2 AS col_idx,
  'replace' AS action, 'EDIT-' || CAST(o_orderkey AS STRING) AS value FROM orders WHERE o_orderkey % 100 = 1
UNION ALL SELECT CAST(o_orderkey * 10 + 1 AS BIGINT), 'orders', o_orderkey, 2, 'replace', 'LAST' FROM orders WHERE o_orderkey % 200 = 1
UNION ALL SELECT CAST(o_orderkey * 10 + 2 AS BIGINT), 'orders', o_orderkey, 5, 'remark_split', '' FROM orders WHERE o_orderkey % 40 IN (1, 2)
UNION ALL SELECT CAST(o_orderkey * 10 + 3 AS BIGINT), 'orders', o_orderkey, 0, 'delete_row', '' FROM orders WHERE o_orderkey % 500 = 9
UNION ALL SELECT CAST(o_orderkey * 10 + 4 AS BIGINT), 'orders', o_orderkey, 99, 'replace', 'x' FROM orders WHERE o_orderkey % 1000 = 4
UNION ALL SELECT CAST(7 AS BIGINT), 'orders', CAST(0 AS BIGINT), 6, 'header_rename', 'Remarks' FROM orders WHERE o_orderkey = 0
"""


def edited_orders(spark, d) -> ed.Edited:
    load(spark, d, "orders").createOrReplaceTempView("tidegrid_edit_orders")
    edits = spark.sql(EDITS_SQL.replace("FROM orders", "FROM tidegrid_edit_orders"))
    return ed.apply_edits(sheets(spark, d, "orders"), materialize(edits))


_inner = "regexp_extract(c5, '（([^（）]*)）[^（]*$', 1)"
_half = r"regexp_extract(c5, '\(([^()]*)\)[^(]*$', 1)"
_ok = "({x} <> '' AND (regexp_matches({x}, '[一-鿿]') OR length({x}) > 5))"
_remark = f"CASE WHEN {_ok.format(x=_inner)} THEN {_inner} WHEN {_ok.format(x=_half)} THEN {_half} END"
_stem = (
    f"CASE WHEN {_ok.format(x=_inner)} THEN {o.trim('regexp_extract(c5, ' + chr(39) + '^((.|[^.])*)（[^（]*$' + chr(39) + ', 1)')} "
    f"WHEN {_ok.format(x=_half)} THEN {o.trim('regexp_extract(c5, ' + chr(39) + '^((.|[^.])*)[(][^(]*$' + chr(39) + ', 1)')} ELSE c5 END"
)


@register(
    f"{o.sheets_cte('orders')}, split AS (SELECT * REPLACE (CASE WHEN row_idx % 200 = 1 THEN 'LAST' WHEN row_idx % 100 = 1 THEN 'EDIT-' || row_idx ELSE c2 END AS c2, "
    f"CASE WHEN row_idx % 40 IN (1, 2) THEN {_stem} ELSE c5 END AS c5), CASE WHEN row_idx % 40 IN (1, 2) THEN {_remark} END AS c9 FROM sheet) "
    f"SELECT sheet_id, row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, {', '.join(ORDER_CELLS)}, c9 FROM split WHERE row_idx % 500 <> 9"
)
def cell_edits(spark, d):
    return edited_orders(spark, d).sheets.rows


@register(
    f"{o.sheets_cte('orders')}, w AS (SELECT row_idx * 10 + 4 AS edit_no, '跳過: replace 指令超出範圍 (row=' || row_idx || ', col=99)' AS warning FROM sheet WHERE row_idx % 1000 = 4 "
    "UNION ALL SELECT row_idx * 10 + 2, '跳過: remark_split ' || CASE WHEN coalesce(c5, '') = '' THEN '目標儲存格為空' ELSE '未偵測到括號備註' END "
    f"|| ' (row=' || row_idx || ', col=5)' FROM sheet WHERE row_idx % 40 IN (1, 2) AND ({_remark}) IS NULL) SELECT edit_no, warning FROM w"
)
def edit_warnings(spark, d):
    return edited_orders(spark, d).warnings.select("edit_no", "warning")


@register(
    f"{o.sheets_cte('orders')} SELECT 'orders' AS sheet_id, col_idx::INT AS col_idx, CASE WHEN col_idx = 6 THEN 'Remarks' ELSE name END AS name FROM headers "
    "UNION ALL SELECT 'orders', 9, '備註'"
)
def edited_headers(spark, d):
    return edited_orders(spark, d).sheets.headers


# Assessment ---------------------------------------------------------------

SCORES_OUT = ", ".join(f"round({k}, 6) AS {k}" for k in lx.INDICATORS)
STATUS_SQL = "CASE WHEN total_score >= 80 THEN 'ready' WHEN total_score >= 60 THEN 'conditional' ELSE 'not_ready' END AS status"


def score_columns(scores: DataFrame) -> DataFrame:
    return scores.select(
        "sheet_id", "n_rows", "high", "medium", "low", *[r6(k) for k in lx.INDICATORS], "total_score", "status"
    )


@register(
    f"{scored_sql(*ALL)} SELECT sheet_id, n_rows, high::BIGINT AS high, medium::BIGINT AS medium, low::BIGINT AS low, {SCORES_OUT}, total_score, {STATUS_SQL} FROM scored"
)
def assessment(spark, d):
    return score_columns(assess(sheets(spark, d, *ALL)).scores)


PLAIN_SQL = (
    "plain AS (SELECT * REPLACE (coalesce(avg_consistency * 100, 100) AS format_consistency, "
    "greatest(0, 100.0 - mh::INT * 20 - has_subtotal::INT * 15 - has_multiple_tables::INT * 25 - notes::INT * 10 - nl::INT * 5)::DOUBLE AS table_structure, "
    "((ident::INT + tim::INT + cat::INT + numc::INT + good::INT) * 20)::DOUBLE AS ai_query_readiness) FROM ind), "
    "plain_total AS (SELECT *, round((row_completeness * 0.25::DOUBLE + column_completeness * 0.25::DOUBLE + format_consistency * 0.15::DOUBLE "
    "+ duplicate_similar * 0.1::DOUBLE + table_structure * 0.1::DOUBLE + ai_query_readiness * 0.15::DOUBLE) * 10) / 10 AS total_score FROM plain)"
)


@register(
    f"{scored_sql('orders', 'customers', 'events')}, {PLAIN_SQL} SELECT sheet_id, n_rows, high::BIGINT AS high, medium::BIGINT AS medium, "
    f"low::BIGINT AS low, {SCORES_OUT}, total_score, {STATUS_SQL} FROM plain_total"
)
def assessment_plain(spark, d):
    return score_columns(assess(sheets(spark, d, "orders", "customers", "events"), with_issues=False, mode="plain").scores)


_EDITED_ROWS = (
    "sheet AS (SELECT * REPLACE (row_number() OVER (PARTITION BY sheet_id ORDER BY row_idx) - 1 AS row_idx, "
    "CASE WHEN sheet_id = 'orders' AND row_idx % 97 = 3 THEN 'EDIT-' || row_idx ELSE c2 END AS c2, "
    "CASE WHEN sheet_id = 'orders' AND row_idx % 89 = 5 THEN NULL ELSE c4 END AS c4) FROM uploaded "
    "WHERE NOT (sheet_id = 'orders' AND (row_idx < 2 OR row_idx % 500 = 9)))"
)
RESCORED_SQL = scored_sql("orders", "customers").replace("WITH sheet AS", "WITH uploaded AS", 1).replace(
    "headers(", f"{_EDITED_ROWS}, headers(", 1)


@register(
    f"{RESCORED_SQL} SELECT sheet_id, n_rows, high::BIGINT AS high, medium::BIGINT AS medium, low::BIGINT AS low, "
    f"{SCORES_OUT}, total_score, {STATUS_SQL} FROM scored"
)
def rescored_edits(spark, d):
    """Scores after cells were edited and rows removed, from the tables of the first assessment and the changed rows."""
    s = sheets(spark, d, "orders", "customers")
    row = F.col("row_idx")
    orders = s.rows.filter("sheet_id = 'orders'").select("sheet_id", "row_idx")
    edited = orders.filter(row % 97 == 3).select(
        "*", F.lit(2).alias("col_idx"), F.concat(F.lit("EDIT-"), row.cast("string")).alias("value"))
    emptied = orders.filter(row % 89 == 5).select(
        "*", F.lit(4).alias("col_idx"), F.lit(None).cast("string").alias("value"))
    removed = orders.filter((row < 2) | (row % 500 == 9))
    return score_columns(rescore(score_state(s), edited.unionByName(emptied), removed).assessment.scores)


@register(
    f"{profile_sql('orders', 'customers', 'parts')} SELECT sheet_id, col_idx::INT AS col_idx, n_nonempty, true AS within_bound "
    "FROM flags WHERE n_nonempty > 0"
)
def distinct_sketches(spark, d):
    """Distinct counts from the sketches of four ingest parts, held against the exact counts."""
    s = sheets(spark, d, "orders", "customers", "parts")
    store = SketchStore(spark, f"{shared_folder(spark)}/tidegrid/sketches-{uuid.uuid4().hex}")
    for part in range(4):
        store.add(f"part{part}", s.with_rows(s.rows.filter(F.col("row_idx") % 4 == part)))
    exact = pf.value_counts(s).groupBy("sheet_id", "col_idx").agg(F.count("*").alias("exact"))
    off = F.abs(F.col("n_distinct") - F.col("exact"))
    return store.distinct_counts().join(exact, ["sheet_id", "col_idx"]).select(
        "sheet_id", "col_idx", "n_nonempty", (off <= F.col("exact") * ERROR_BOUND).alias("within_bound"))


ISSUES_SQL = f"""{scored_sql('orders', 'customers', 'events')},
rowflags AS (SELECT f.sheet_id, f.row_idx, bool_or(fmt = 'TEXT') AS has_text, bool_or(f.is_placeholder) AS ph,
  bool_or(p.is_mostly_numeric AND NOT f.is_numcur) AS mm FROM facts f JOIN flags p USING (sheet_id, col_idx) GROUP BY ALL),
rowsum AS (SELECT sheet_id, count(*) FILTER (WHERE has_text) AS rows_text, count(*) FILTER (WHERE ph) AS rows_ph,
  count(*) FILTER (WHERE mm) AS rows_mm FROM rowflags GROUP BY 1),
lowcols AS (SELECT p.sheet_id, p.col_idx FROM flags p JOIN scored s USING (sheet_id)
  WHERE p.fill_ratio < CASE WHEN s.column_completeness < 60 THEN 0.5 ELSE 0.7 END),
lowrows AS (SELECT r.sheet_id, count(DISTINCT r.row_idx) AS rows_low FROM sheet r JOIN lowcols l USING (sheet_id)
  ANTI JOIN cells c ON c.sheet_id = r.sheet_id AND c.row_idx = r.row_idx AND c.col_idx = l.col_idx GROUP BY 1),
worst AS (SELECT sheet_id, max(n_mismatch / n_nonempty) > 0.1 AS many FROM flags WHERE n_mismatch > 0 GROUP BY 1),
spelled AS (SELECT sheet_id, replace(v, chr(10), ' ') AS spelling, {o.entity_key('replace(v, chr(10), chr(32))')} AS key, count(*) AS n
  FROM cells WHERE sheet_id IN ('orders', 'customers') AND col_idx = 1 GROUP BY ALL),
variants AS (SELECT sheet_id, sum(n) - sum(mx) AS n FROM (SELECT sheet_id, key, sum(n) AS n, max(n) AS mx FROM spelled
  GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
rem AS (SELECT sheet_id, sum(n_remark) AS n FROM flags WHERE is_structured GROUP BY 1),
raw_issues AS (
  SELECT sheet_id, 1 AS pos, CASE WHEN row_completeness < 60 THEN '資料大量缺漏' ELSE '部分資料缺漏' END AS title,
    CASE WHEN row_completeness < 60 THEN 3 ELSE 2 END AS sev, n_incomplete AS affected, '列受影響' AS unit, 'row_completeness' AS ind FROM scored WHERE row_completeness < 80
  UNION ALL SELECT sheet_id, 2, CASE WHEN column_completeness < 60 THEN '資料大量缺漏' ELSE '部分資料缺漏' END,
    CASE WHEN column_completeness < 60 THEN 3 ELSE 2 END, rows_low, '列受影響', 'column_completeness' FROM scored JOIN lowrows USING (sheet_id) WHERE column_completeness < 80
  UNION ALL SELECT sheet_id, 3, CASE WHEN format_consistency < 60 THEN '日期格式不一致' ELSE '格式混用' END,
    CASE WHEN format_consistency < 60 THEN 3 ELSE 2 END, rows_text, '列', 'format_consistency' FROM scored JOIN rowsum USING (sheet_id)
    WHERE format_consistency < 80 AND sheet_id IN (SELECT sheet_id FROM flags WHERE consistency < 0.8)
  UNION ALL SELECT sheet_id, 4, '疑似重複資料', CASE WHEN duplicate_similar < 60 THEN 3 ELSE 2 END,
    n_rows - floor(duplicate_similar * n_rows / 100), '組', 'duplicate_similar' FROM scored WHERE duplicate_similar < 80
  UNION ALL SELECT sheet_id, 5, '客戶名稱不一致', 2, n, '列', 'name_variants' FROM variants WHERE n > 0
  UNION ALL SELECT sheet_id, 6, '表格結構問題', CASE WHEN table_structure < 60 THEN 3 WHEN table_structure < 80 THEN 2 ELSE 1 END,
    has_subtotal::INT + has_multiple_tables::INT + nl::INT, '處', 'table_structure' FROM scored
    WHERE table_structure < 100 AND has_subtotal::INT + has_multiple_tables::INT + nl::INT > 0
  UNION ALL SELECT sheet_id, 7, '表格結構問題', 2, n_orphans, '處', 'table_structure' FROM scored WHERE n_orphans > 0
  UNION ALL SELECT sheet_id, 8, '「同XX」引用未填入實際值', 3, rows_ph, '列受影響', 'cell_reference_placeholder' FROM rowsum WHERE rows_ph > 0
  UNION ALL SELECT sheet_id, 9, '欄位型別不一致', CASE WHEN many THEN 3 ELSE 2 END, rows_mm, '列受影響', 'column_type_mismatch' FROM rowsum JOIN worst USING (sheet_id)
  UNION ALL SELECT sheet_id, 10, '空白標題欄', 2, count(*), '欄', 'empty_header' FROM headers WHERE trim(name) = '' GROUP BY 1
  UNION ALL SELECT sheet_id, 11, '行內備註混入資料欄', 2, n, '處', 'inline_remark' FROM rem WHERE n > 0
  UNION ALL SELECT sheet_id, 13, 'AI 應用完備度', CASE WHEN ai_query_readiness < 60 THEN 3 ELSE 2 END, n_rows, '列', 'ai_query_readiness' FROM scored WHERE ai_query_readiness < 80),
merged AS (SELECT sheet_id, title, min(pos) AS pos, max(sev) AS sev, max(affected)::BIGINT AS affected_rows, arg_min(unit, pos) AS unit,
  CASE WHEN count(*) > 1 THEN 'completeness' ELSE any_value(ind) END AS indicator FROM raw_issues GROUP BY 1, 2),
issues AS (SELECT sheet_id, (row_number() OVER (PARTITION BY sheet_id ORDER BY pos))::INT AS pos, title,
  CASE sev WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity, affected_rows, unit, indicator FROM merged)"""


@register(f"{ISSUES_SQL} SELECT * FROM issues")
def issues(spark, d):
    found = iss.detect_issues(assess(sheets(spark, d, "orders", "customers", "events")))
    return found.select("sheet_id", "pos", "title", "severity", "affected_rows", "unit", "indicator")


@register()
def issue_examples(spark, d):
    found = iss.detect_issues(assess(sheets(spark, d, *ALL)))
    return found.select("sheet_id", "pos", "title_en", "description", "description_en", F.to_json("examples").alias("examples"))


@register(
    f"{profile_sql('orders', 'customers')}, k AS (SELECT f.sheet_id, f.row_idx, f.col_idx, p.name AS col_name, f.raw, unnest(list_filter(["
    "CASE WHEN f.is_placeholder THEN 'cell_reference_placeholder' END, CASE WHEN p.is_mostly_numeric AND NOT f.is_numcur THEN 'column_type_mismatch' END, "
    "CASE WHEN p.is_structured AND f.is_remark THEN 'inline_remark' END], lambda x: x IS NOT NULL)) AS issue_type FROM facts f JOIN flags p USING (sheet_id, col_idx)) "
    "SELECT * REPLACE (CASE WHEN col_name = '' THEN '第' || (col_idx + 1) || '欄' ELSE col_name END AS col_name) FROM k "
    "UNION ALL SELECT sheet_id, -1, col_idx, '第' || (col_idx + 1) || '欄', '', 'empty_header' FROM headers WHERE name = ''"
)
def flagged_cells(spark, d):
    return iss.flagged_cells(assess(sheets(spark, d, "orders", "customers")))


@register(
    f"{ISSUES_SQL}, f AS (SELECT sheet_id, bool_or(indicator = 'duplicate_similar') AS dup, bool_or(indicator = 'name_variants') AS nam, "
    "bool_or(indicator = 'completeness') AS com, bool_or(title = '表格結構問題') AS stru, bool_or(title IN ('部分資料缺漏', '資料大量缺漏')) AS gap, "
    "bool_or(indicator = 'inline_remark') AS rem FROM issues GROUP BY 1) SELECT sheet_id, rule FROM (SELECT f.sheet_id, unnest(list_filter(["
    "'date_normalize', CASE WHEN dup THEN 'dedup' END, CASE WHEN nam THEN 'name_normalize' END, "
    "CASE WHEN stru AND has_subtotal THEN 'subtotal_remove' END, CASE WHEN stru AND nl THEN 'newline_remove' END, "
    "CASE WHEN rem THEN 'bracket_note_remove' END, CASE WHEN com OR (stru AND has_multiple_tables) THEN 'empty_row_remove' END, "
    "CASE WHEN stru AND has_multiple_tables THEN 'multi_table_keep_main' END, "
    "CASE WHEN com OR (gap AND false) THEN 'empty_col_remove' END], lambda x: x IS NOT NULL)) AS rule FROM f JOIN scored s ON s.sheet_id = f.sheet_id)"
)
def recommended_rules(spark, d):
    found = iss.detect_issues(assess(sheets(spark, d, "orders", "customers", "events")))
    return cp.recommend_rules(found).select("sheet_id", "rule")


def after_scored_sql() -> str:
    """Scores of the orders sheet after removing subtotal rows and line breaks, plain indicators."""
    w = 9
    changed = (
        f"{o.sheets_cte('orders')}".replace("WITH sheet AS (", "WITH before AS (", 1)
        .replace(", headers(", f", sheet AS (SELECT * REPLACE (row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, replace(c6, chr(10), ' ') AS c6) "
                 f"FROM before WHERE NOT ({_subtotal})), headers(", 1)
    )
    return (
        f"{changed}, {o.cells_cte(w)}, {o.facts_cte()}, {o.profile_cte()}, {o.rows_cte(w)}, {o.near_cte()}, {o.scores_cte(w)}, "
        f"{PLAIN_SQL}, adjusted AS (SELECT * REPLACE (round(((row_completeness * 0.25::DOUBLE + column_completeness * 0.25::DOUBLE + format_consistency * 0.15::DOUBLE "
        "+ duplicate_similar * 0.1::DOUBLE + table_structure * 0.1::DOUBLE + ai_query_readiness * 0.15::DOUBLE) * 0.6::DOUBLE "
        "+ high / (high + medium + low) * 100 * 0.4::DOUBLE) * 10) / 10 AS total_score) FROM plain_total)"
    )


def _unpivot(sql: str, table: str, name: str) -> str:
    cols = ", ".join([*[f"{k}::DOUBLE AS {k}" for k in lx.INDICATORS], "total_score::DOUBLE AS total_score"])
    return (
        f"SELECT measure, {name} FROM (UNPIVOT (SELECT {cols} FROM ({sql} SELECT * FROM {table})) "
        f"ON {', '.join([*lx.INDICATORS, 'total_score'])} INTO NAME measure VALUE {name})"
    )


@register(
    f"SELECT 'orders' AS sheet_id, measure, round(b.before, 6) AS before, round(a.after, 6) AS after FROM ({_unpivot(scored_sql('orders'), 'scored', 'before')}) b "
    f"JOIN ({_unpivot(after_scored_sql(), 'adjusted', 'after')}) a USING (measure)"
)
def compare_before_after(spark, d):
    s = sheets(spark, d, "orders")
    after = clean(s, ["subtotal_remove", "newline_remove"]).refined()
    t = cp.compare(assess(s).scores, assess(after, with_issues=False).scores)
    return t.select("sheet_id", "measure", r6("before"), r6("after"))


@register(
    f"SELECT 'orders' AS sheet_id, 'subtotal_remove,newline_remove' AS rules, rows_before, rows_after, s.score_before, s.score_after, "
    "'op-1' AS user_id, '2024-01-01 08:00:00' AS created_at FROM (SELECT round(b.before, 6) AS score_before, round(a.after, 6) AS score_after "
    f"FROM ({_unpivot(scored_sql('orders'), 'scored', 'before')}) b JOIN ({_unpivot(after_scored_sql(), 'adjusted', 'after')}) a USING (measure) "
    f"WHERE measure = 'total_score') s, ({o.sheets_cte('orders')} SELECT count(*) AS rows_before, count(*) FILTER (WHERE NOT ({_subtotal})) AS rows_after FROM sheet) n"
)
def cleaning_session(spark, d):
    """Rows, rules and scores of a cleaning run."""
    done = run_session(sheets(spark, d, "orders"), ["subtotal_remove", "newline_remove"], "op-1", SESSION_TIME)
    return done.sessions.select(
        "sheet_id", F.array_join("rules_applied", ",").alias("rules"), "rows_before", "rows_after", r6("score_before"),
        r6("score_after"), "user_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@register(
    f"{o.sheets_cte('orders')}, s1 AS (SELECT *, ({_subtotal}) AS gone FROM sheet), "
    "kept AS (SELECT * REPLACE (row_number() OVER (ORDER BY row_idx) - 1 AS row_idx) FROM s1 WHERE NOT gone), "
    "hits AS (SELECT 0 AS seq, 'subtotal_remove' AS operation_type, row_idx FROM s1 WHERE gone "
    "UNION ALL SELECT 1, 'newline_remove', row_idx FROM kept WHERE contains(c6, chr(10))), "
    "islands AS (SELECT *, row_idx - row_number() OVER (PARTITION BY seq ORDER BY row_idx) AS island FROM hits) "
    "SELECT seq::INT AS seq, operation_type, min(row_idx)::BIGINT AS first, max(row_idx)::BIGINT AS last, 'op-1' AS operator_id, "
    "any_value(n)::BIGINT AS n_rows FROM islands JOIN (SELECT seq, count(*) AS n FROM hits GROUP BY 1) USING (seq) GROUP BY seq, operation_type, island"
)
def stored_log_runs(spark, d):
    """The stored log: positions as a rule finds them, as runs of consecutive rows, with the operator."""
    done = clean(sheets(spark, d, "orders"), ["subtotal_remove", "newline_remove"])
    return done.stored_entries("op-1", SESSION_TIME).select("seq", "operation_type", "first", "last", "operator_id", "n_rows")


@register()
def resolved_issues(spark, d):
    s = sheets(spark, d, "orders")
    after = clean(s, ["multi_table_keep_main", "subtotal_remove", "newline_remove", "bracket_note_remove"]).sheets
    before = iss.detect_issues(assess(s))
    left = iss.detect_issues(assess(after, with_issues=False))
    return cp.resolved_issues(before, left).select("sheet_id", "title", "severity", "affected_rows")


@register(
    f"{scored_sql('orders', 'customers')} SELECT sheet_id, i.pos::INT AS pos, i.name, printf('%.1f', i.score) AS score, i.weight FROM scored, "
    "LATERAL (SELECT unnest([" + ", ".join(
        f"{{'pos': {n}, 'name': '{lx.INDICATOR_LABELS[k]}', 'score': {k}, 'weight': '{round(w * 100)}%'}}"
        for n, (k, w) in enumerate(lx.DEFAULT_WEIGHTS.items())
    ) + "]) AS i)"
)
def report_indicators(spark, d):
    return rp.indicator_table(assess(sheets(spark, d, "orders", "customers")).scores)


# Gate, snippet, fingerprint -----------------------------------------------

QUESTION = "What is the memo and status of each order ID by event_type?"


@register(
    f"{o.sheets_cte(*ALL)}, rates AS (SELECT h.*, rate FROM headers h JOIN ("
    + " UNION ALL ".join(
        f"SELECT sheet_id, {i} AS col_idx, count(*) FILTER (WHERE NOT ({nonblank(f'c{i}')})) / count(*) AS rate FROM sheet GROUP BY 1"
        for i in range(9)
    )
    + f") USING (sheet_id, col_idx)), m AS (SELECT *, trim(name) <> '' AND contains(lower('{QUESTION}'), lower(trim(name))) AS named FROM rates), "
    "a AS (SELECT *, named OR NOT bool_or(named) OVER (PARTITION BY sheet_id) AS asked FROM m), "
    "b AS (SELECT sheet_id, string_agg(name || ' (缺漏率 ' || printf('%.0f', rate * 100) || '%)', '、' ORDER BY col_idx) FILTER (WHERE asked AND rate > 0.5) AS bad FROM a GROUP BY 1) "
    "SELECT sheet_id, bad IS NOT NULL AS blocked, CASE WHEN bad IS NULL THEN '' ELSE '資料不足：以下欄位缺漏率超過 50% 門檻值 — ' || bad END AS explanation FROM b"
)
def guardrail(spark, d):
    return gate.check_question(sheets(spark, d, *ALL), QUESTION)


@register(
    f"{o.sheets_cte('events')} SELECT row_idx + 1 AS line_no, concat_ws(',', c0, c1, c2, c3, coalesce(c4, ''), c5) AS line FROM sheet WHERE row_idx < 500 "
    "UNION ALL SELECT 0, string_agg(name, ',' ORDER BY col_idx) FROM headers"
)
def prompt_snippet(spark, d):
    return gate.prompt_snippet(sheets(spark, d, "events")).select("line_no", "line")


def _entry_sql(position: str, cell: str) -> str:
    return f"CASE WHEN coalesce({cell}, '') <> '' THEN {position} || '=' || length({cell}) || ':' || {cell} ELSE '' END"


_digest = "sha256(row_idx || '|' || " + " || ".join(_entry_sql(f"'{i}'", f"c{i}") for i in range(9)) + ")"
_header_digest = f"sha256('-1|' || string_agg({_entry_sql('col_idx', 'name')}, '' ORDER BY col_idx))"
FINGERPRINT_SQL = (
    f"{o.sheets_cte('orders', 'customers')}, dg AS (SELECT sheet_id, 1 AS is_row, {_digest} AS h FROM sheet "
    f"UNION ALL SELECT sheet_id, 0, {_header_digest} FROM headers GROUP BY 1), s AS (SELECT sheet_id, sum(is_row)::BIGINT AS n_rows, "
    + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS s{i}" for i in range(8))
    + " FROM dg GROUP BY 1) SELECT sheet_id, n_rows, sha256(concat_ws('|', n_rows::VARCHAR, "
    + ", ".join(f"s{i}::VARCHAR" for i in range(8)) + ")) AS fingerprint FROM s"
)


@register(FINGERPRINT_SQL)
def fingerprint(spark, d):
    return fp.dataset_fingerprint(fp.row_digests(sheets(spark, d, "orders", "customers")))


@register(
    f"{o.sheets_cte('orders')} SELECT DISTINCT sheet_id, ((row_idx + 1) // 1024 * 1024 - 1)::BIGINT AS first_row, "
    "((row_idx + 1) // 1024 * 1024 + 1022)::BIGINT AS last_row FROM sheet WHERE row_idx % 5000 = 7")
def changed_stretches(spark, d):
    """Stretches of rows that differ between a sheet and a copy with a few changed cells, by their hash trees."""
    s = sheets(spark, d, "orders")
    edited = s.with_rows(s.rows.withColumn("c1", F.when(F.col("row_idx") % 5000 == 7, "edited").otherwise(F.col("c1"))))
    return fp.changed_stretches(fp.hash_tree(fp.row_digests(s)), fp.hash_tree(fp.row_digests(edited)))


@register(
    f"{o.sheets_cte('orders', 'customers')} SELECT DISTINCT sheet_id, sheet_id = 'customers' AS is_valid, "
    "sha256('raw:' || sheet_id) AS fallback FROM sheet")
def fingerprint_verify(spark, d):
    """Recorded against recomputed fingerprints, one sheet changed since; the stand-in for lost artifacts."""
    s = sheets(spark, d, "orders", "customers")
    hit = (F.col("sheet_id") == "orders") & (F.col("row_idx") == 3)
    edited = s.with_rows(s.rows.withColumn("c0", F.when(hit, "edited").otherwise(F.col("c0"))))
    recorded, now = (fp.dataset_fingerprint(fp.row_digests(x)) for x in (s, edited))
    return fp.verify(now, recorded).withColumn("fallback", fp.fallback_fingerprint(F.col("sheet_id")))


# Usage --------------------------------------------------------------------

def wall_clock(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


@register(
    "SELECT user_id, date_trunc('week', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR AS period_start, count(*) AS used FROM events GROUP BY 1, 2"
)
def usage_weekly(spark, d):
    return wall_clock(us.usage_by_period(load(spark, d, "events"), "user_id", "ts", "weekly"), "period_start")


@register(
    "SELECT user_id, date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR AS period_start, count(*) AS used FROM events GROUP BY 1, 2"
)
def usage_daily(spark, d):
    return wall_clock(us.usage_by_period(load(spark, d, "events"), "user_id", "ts", "daily"), "period_start")


NOW = "2024-01-20 05:00:00"


@register(
    f"WITH u AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'signup' AND ts < TIMESTAMP '{NOW}') AS last_reset FROM events GROUP BY 1), "
    f"b AS (SELECT user_id, CASE WHEN last_reset < date_trunc('week', TIMESTAMP '{NOW}' + INTERVAL 8 HOUR) - INTERVAL 8 HOUR THEN TIMESTAMP '{NOW}' ELSE last_reset END AS since "
    "FROM u WHERE last_reset IS NOT NULL), c AS (SELECT b.user_id, count(e.ts) AS used FROM b LEFT JOIN events e ON e.user_id = b.user_id AND e.event_type = 'purchase' AND e.ts >= b.since GROUP BY 1) "
    "SELECT user_id, used, greatest(0, 3 - used) AS remaining, used < 3 AS allowed, "
    f"date_trunc('week', TIMESTAMP '{NOW}' + INTERVAL 8 HOUR) + INTERVAL 7 DAY - INTERVAL 8 HOUR AS next_reset FROM c"
)
def quota_status(spark, d):
    e = load(spark, d, "events")
    now = F.lit(NOW).cast("timestamp")
    users = e.filter((F.col("event_type") == "signup") & (F.col("ts") < now)).groupBy("user_id").agg(
        F.max("ts").alias("last_reset")
    )
    made = e.filter(F.col("event_type") == "purchase").select("user_id", F.col("ts").alias("created_at"))
    return wall_clock(us.quota_status(users, made, now, 3, "weekly"), "next_reset")


def attempts(spark, d) -> DataFrame:
    return load(spark, d, "events").select(
        "event_id", "user_id", F.col("ts").alias("attempted_at"), (F.col("event_type") != "error").alias("success")
    )


@register(
    "SELECT event_id, user_id, ts AS attempted_at, event_type <> 'error' AS success, "
    "count(*) FILTER (WHERE event_type = 'error') OVER w AS failures, count(*) FILTER (WHERE event_type = 'error') OVER w >= 5 AS blocked FROM events "
    "WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10080 MINUTE PRECEDING AND CURRENT ROW)"
)
def lockout_checks(spark, d):
    return us.lockout_checks(attempts(spark, d), minutes=10080)


@register(
    f"SELECT user_id, count(*) AS failures, count(*) >= 5 AS blocked FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '{NOW}' - INTERVAL 10080 MINUTE GROUP BY 1"
)
def lockout_now(spark, d):
    return us.is_blocked(attempts(spark, d), F.lit(NOW).cast("timestamp"), minutes=10080)


@register(
    "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
)
def latest_per_user(spark, d):
    return us.latest_per(load(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id")


@register("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def assessment_page(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return us.paginate(t, [F.desc("o_orderdate"), F.asc("o_orderkey")], page=3)


@register("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 5980")
def deep_page(spark, d):
    """Page 300 by the rank directory: only the range that holds it is read."""
    t = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lk.rank_directory(t, ["-o_orderdate", "o_orderkey"], range_rows=2000).page(300)


def as_uploads(spark, d):
    """Orders stand in for assessments, customers for uploads, nations for users."""
    made = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("upload_id"), F.col("o_orderdate").alias("created_at")
    )
    files = load(spark, d, "customer").select(
        F.col("c_custkey").alias("upload_id"), F.col("c_nationkey").alias("user_id"), F.concat("c_name", F.lit(".v1.xlsx")).alias("filename")
    )
    return made, files


@register(
    "SELECT n_nationkey AS user_id, n_name, coalesce(used, 0) AS used, greatest(0, 400 - coalesce(used, 0)) AS remaining FROM nation LEFT JOIN "
    "(SELECT c_nationkey, count(*) AS used FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) ON c_nationkey = n_nationkey"
)
def users_with_usage(spark, d):
    made, files = as_uploads(spark, d)
    users = load(spark, d, "nation").select(F.col("n_nationkey").alias("user_id"), "n_name")
    used = us.usage_since(made, files, F.lit("1998-01-01").cast("timestamp"))
    return us.users_with_usage(users, used, 400)


@register(
    "SELECT o_orderkey AS id, o_custkey AS upload_id, CASE WHEN o_orderkey % 3 = 0 THEN 'named-' || o_orderkey ELSE c_name || '.v1' END AS filename "
    "FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
)
def filename_backfill(spark, d):
    made, files = as_uploads(spark, d)
    given = F.when(F.col("id") % 3 == 0, F.concat(F.lit("named-"), F.col("id"))).when(F.col("id") % 3 == 1, "")
    return us.backfill_filename(made.select("id", "upload_id", given.alias("filename")), files).select("id", "upload_id", "filename")


def translations(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, d, "part").select(
        F.when(k % 2 == 0, "en").otherwise("zh-TW").alias("locale"),
        F.concat(F.lit("part."), (k % 1000).cast("string")).alias("key"), F.col("p_name").alias("value"),
        k.alias("updated_at"),
    )


TRANSLATIONS_SQL = (
    "WITH t AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'zh-TW' END AS locale, 'part.' || (p_partkey % 1000) AS key, p_name AS value, p_partkey AS updated_at FROM part)"
)


@register(f"{TRANSLATIONS_SQL} SELECT * FROM t WHERE locale = 'en' AND (key ILIKE '%WIDGET%' OR value ILIKE '%WIDGET%')")
def translation_search(spark, d):
    return us.search_translations(translations(spark, d), "en", "WIDGET")


@register(f"{TRANSLATIONS_SQL} SELECT * FROM t WHERE key ILIKE '%WIDGET%' OR value ILIKE '%WIDGET%'")
def translation_search_indexed(spark, d):
    """The search by trigram posting lists over all names."""
    return lk.search_text(lk.trigram_index(translations(spark, d), ["key", "value"]), "WIDGET")


@register(
    f"{TRANSLATIONS_SQL}, u AS (SELECT locale, key, arg_max(value, updated_at) AS value FROM t GROUP BY 1, 2) "
    "SELECT locale, key, value FROM u WHERE locale = 'en'")
def locale_texts(spark, d):
    """The map of a locale's texts, entry by entry."""
    t = translations(spark, d)
    latest = us.upsert(t, t.limit(0), ["locale", "key"], "updated_at")
    return us.locale_map(latest, "en").select("locale", F.explode("texts").alias("key", "value"))


@register(
    f"{TRANSLATIONS_SQL} SELECT locale, key, arg_max(value, updated_at) AS value, max(updated_at) AS updated_at FROM "
    "(SELECT * FROM t UNION ALL SELECT locale, key, upper(value), updated_at + 1000000 FROM t WHERE updated_at % 3 = 0) GROUP BY 1, 2"
)
def settings_upsert(spark, d):
    t = translations(spark, d)
    changes = t.filter(F.col("updated_at") % 3 == 0).select(
        "locale", "key", F.upper("value").alias("value"), (F.col("updated_at") + 1000000).alias("updated_at")
    )
    return us.upsert(t, changes, ["locale", "key"], "updated_at")


@register(
    f"{TRANSLATIONS_SQL} SELECT locale, key, arg_max(value, updated_at) AS value, max(updated_at) AS updated_at FROM "
    "(SELECT * FROM t UNION ALL SELECT locale, key, upper(value), updated_at + 1000000 FROM t WHERE updated_at % 3 = 0) GROUP BY 1, 2"
)
def keyed_upsert(spark, d):
    """The upsert on a bucketed table, its batch tried twice."""

    t = translations(spark, d).select("locale", "key", "value", "updated_at")
    first = us.upsert(t, t.limit(0), ["locale", "key"], "updated_at")
    table = keyed_table(first, f"{shared_folder(spark)}/tidegrid/keyed-{uuid.uuid4().hex}", ["locale", "key"], 16)
    changes = t.filter(F.col("updated_at") % 3 == 0).withColumns(
        {"value": F.upper("value"), "updated_at": F.col("updated_at") + 1000000})
    table.upsert(changes, "updated_at")
    table.upsert(changes, "updated_at")
    return table.rows()


# Anonymisation ------------------------------------------------------------

CLIENT_POOL = [f"Client {i}" for i in range(1, 18)]
WORDS = {"小計": "Subtotal", "合計": "Sum", "同": "Like ", "備註": "Note"}


def _salted_sql(key: str) -> str:
    return f"(('0x' || left(sha256('demo:' || {key}), 15))::BIGINT)"


@register(
    "SELECT c_custkey, 'Client ' || (" + _salted_sql("left(c_name, 20)") + " % 17 + 1) AS client, "
    "'PO-' || (" + _salted_sql("c_custkey::VARCHAR") + " % 9000 + 1000) AS po FROM customer"
)
def pseudonymise_customers(spark, d):
    t = load(spark, d, "customer")
    return t.select(
        "c_custkey", an.pseudonym(F.col("c_name"), CLIENT_POOL, "demo").alias("client"),
        an.masked_code(F.col("c_name"), "PO", 1000, 9999, F.col("c_custkey"), "demo").alias("po"),
    )


def _translated(x: str) -> str:
    for zh, en_ in WORDS.items():
        x = f"replace({x}, '{zh}', '{en_}')"
    return x


@register(
    f"{o.sheets_cte('orders', 'customers')}, {o.cells_cte(9)}, t AS (SELECT sheet_id, row_idx, col_idx, raw, {_translated('raw')} AS en FROM cells) "
    "SELECT sheet_id, row_idx, col_idx, en AS translated, CASE WHEN regexp_matches(raw, '[一-鿿㐀-䶿]') THEN nullif(CASE WHEN regexp_matches(en, '[一-鿿㐀-䶿]') THEN "
    f"{o.trim('regexp_replace(en, ' + chr(39) + '[一-鿿㐀-䶿]+' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} ELSE en END, '') ELSE raw END AS stripped FROM t"
)
def translate_values(spark, d):
    raw = F.col("raw")
    return sheets(spark, d, "orders", "customers").cells().select(
        "sheet_id", "row_idx", "col_idx", an.translate_value(raw, WORDS).alias("translated"), an.strip_cjk(raw, WORDS).alias("stripped")
    )


# Grids and files ----------------------------------------------------------

GRID_SQL = """
WITH b AS (
  SELECT o_custkey AS ck, o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS amt,
         CAST(CAST(o_orderdate AS DATE) AS STRING) AS dt, o_orderstatus AS st,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS rn
  FROM orders
), c AS (SELECT DISTINCT ck FROM b)
SELECT 'cust-' || CAST(ck AS STRING) AS sheet_id, 0 AS row_no, 'Orders of ' || CAST(ck AS STRING) AS c0,
       CAST(NULL AS STRING) AS c1, CAST(NULL AS STRING) AS c2, CAST(NULL AS STRING) AS c3, CAST(NULL AS STRING) AS c4 FROM c WHERE ck % 3 <> 0
UNION ALL
SELECT 'cust-' || CAST(ck AS STRING), CASE WHEN ck % 3 <> 0 THEN 1 ELSE 0 END, 'Order', 'Amount', 'Order date', 'Status', 'Note' FROM c
UNION ALL
SELECT 'cust-' || CAST(ck AS STRING), rn + CASE WHEN ck % 3 <> 0 THEN 1 ELSE 0 END, 'ORD-' || CAST(k AS STRING), amt, dt,
       CASE WHEN k % 4 = 0 THEN '' ELSE st END, CASE WHEN k % 5 = 0 THEN 'late' END FROM b
"""


def customer_grid(spark, d):
    """One small grid per customer: title row, header row, orders; every third has no title."""
    def derive() -> DataFrame:
        load(spark, d, "orders").createOrReplaceTempView("tidegrid_grid_orders")
        return spark.sql(GRID_SQL.replace("FROM orders", "FROM tidegrid_grid_orders"))

    grid = ingested(spark, d, "customer_grid", derive)
    titled = grid.filter(F.col("c0").startswith("Orders of ")).select("sheet_id")
    one = [F.lit(1).alias(c) for c in ("start_row", "end_row", "start_col")]
    merged = titled.select("sheet_id", *one, F.lit(4).alias("end_col"))
    key = F.substring("sheet_id", 6, 20).cast("long")
    hidden = grid.select("sheet_id").distinct().filter(key % 5 == 0).select("sheet_id", F.lit(1).alias("sheet_col"))
    return grid, merged, hidden


HEADER_SQL = f"WITH grid AS ({GRID_SQL})"


@register(f"{HEADER_SQL} SELECT sheet_id, min(row_no)::INT AS header_row FROM grid WHERE c0 = 'Order' GROUP BY 1")
def header_detection(spark, d):
    grid, merged, _ = customer_grid(spark, d)
    return gr.detect_header(gr.header_scores(gr.fill_merged(grid, merged)))


@register(
    f"{HEADER_SQL} SELECT sheet_id, row_no::INT AS row_no, c0, CASE WHEN starts_with(c0, 'Orders of') THEN c0 ELSE c1 END AS c1, "
    "CASE WHEN starts_with(c0, 'Orders of') THEN c0 ELSE c2 END AS c2, CASE WHEN starts_with(c0, 'Orders of') THEN c0 ELSE c3 END AS c3, c4 FROM grid"
)
def merged_fill(spark, d):
    grid, merged, _ = customer_grid(spark, d)
    return gr.fill_merged(grid, merged)


TALL_GRID_SQL = (
    "SELECT o_orderpriority AS sheet_id, o_orderkey - 1 AS row_no, "
    "o_orderkey::VARCHAR AS c0, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN '' END AS c1, "
    "CASE WHEN o_orderkey % 5 = 0 THEN 'v' || o_orderkey END AS c2, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus || o_custkey ELSE '' END AS c3 "
    "FROM orders")
#: Ranges that begin at every row whose number divides by the first value, and reach down to the second and across to the columns.
TALL_RANGES = [(1000, 700, 2, 4), (97, 5000, 2, 2), (13, 5, 3, 4), (11, 1, 3, 4), (500_000, 10_000_000, 4, 4)]


@register(
    f"WITH grid AS ({TALL_GRID_SQL}), ranges AS (" + " UNION ALL ".join(
        f"SELECT sheet_id, row_no * 8 + {k} AS range_no, row_no AS first, row_no + {down} AS last, {a} AS a, {b} AS b, c{a - 1} AS value "
        f"FROM grid WHERE row_no % {step} = 0 AND coalesce(c{a - 1}, '') <> ''" for k, (step, down, a, b) in enumerate(TALL_RANGES))
    + "), cells AS (SELECT sheet_id, row_no, unnest([0, 1, 2, 3]) AS i, unnest([c0, c1, c2, c3]) AS v FROM grid), filled AS ("
    "SELECT c.sheet_id, c.row_no, c.i, arg_min(r.value, r.range_no) AS value FROM cells c JOIN ranges r ON c.sheet_id = r.sheet_id "
    "AND c.row_no BETWEEN r.first AND r.last AND c.i + 1 BETWEEN r.a AND r.b WHERE coalesce(c.v, '') = '' GROUP BY 1, 2, 3) "
    "SELECT sheet_id, row_no::BIGINT AS row_no, i::INT AS col_idx, coalesce(f.value, v) AS value FROM cells LEFT JOIN filled f USING (sheet_id, row_no, i)"
)
def merged_tall(spark, d):
    """Ranges over most of a sheet, ranges inside and across them, and short ones."""
    t = load(spark, d, "orders")
    k = F.col("o_orderkey")
    grid = materialize(t.select(
        F.col("o_orderpriority").alias("sheet_id"), (k - 1).cast("long").alias("row_no"),
        k.cast("string").alias("c0"), F.when(k % 7 == 0, F.col("o_orderstatus")).when(k % 2 == 0, "").alias("c1"),
        F.when(k % 5 == 0, F.concat(F.lit("v"), k.cast("string"))).alias("c2"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat("o_orderstatus", F.col("o_custkey").cast("string"))).otherwise("").alias("c3")))
    at = F.col("row_no")
    ranges = [grid.filter(at % step == 0).select(
        "sheet_id", (at * 8 + n).alias("range_no"), (at + 1).alias("start_row"), F.lit(a).alias("start_col"),
        (at + 1 + down).alias("end_row"), F.lit(b).alias("end_col")) for n, (step, down, a, b) in enumerate(TALL_RANGES)]
    filled = gr.fill_merged(grid, reduce(DataFrame.unionByName, ranges))
    return filled.select("sheet_id", "row_no", F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("col_idx", "value"))


@register(
    f"{HEADER_SQL}, h AS (SELECT sheet_id, min(row_no) AS hr, substr(sheet_id, 6)::BIGINT % 5 = 0 AS hid FROM grid WHERE c0 = 'Order' GROUP BY 1) "
    "SELECT sheet_id, (row_no - hr - 1)::BIGINT AS row_idx, c0, CASE WHEN hid THEN c2 ELSE c1 END AS c1, CASE WHEN hid THEN c3 ELSE c2 END AS c2, "
    "CASE WHEN hid THEN c4 ELSE c3 END AS c3, CASE WHEN hid THEN NULL ELSE c4 END AS c4 FROM grid JOIN h USING (sheet_id) WHERE row_no > hr"
)
def grid_sheets(spark, d):
    grid, merged, hidden = customer_grid(spark, d)
    return gr.sheets_from_grid(grid, merged, hidden).rows


def _batch_sql() -> str:
    width = 5
    sheet = (
        f"WITH grid AS ({GRID_SQL}), h AS (SELECT sheet_id, min(row_no) AS hr FROM grid WHERE c0 = 'Order' GROUP BY 1), "
        "sheet AS (SELECT sheet_id, (row_no - hr - 1)::BIGINT AS row_idx, c0, c1, c2, c3, c4 FROM grid JOIN h USING (sheet_id) WHERE row_no > hr), "
        "headers AS (SELECT sheet_id, i.col_idx, i.name FROM h, LATERAL (SELECT unnest([{'col_idx': 0, 'name': 'Order'}, {'col_idx': 1, 'name': 'Amount'}, "
        "{'col_idx': 2, 'name': 'Order date'}, {'col_idx': 3, 'name': 'Status'}, {'col_idx': 4, 'name': 'Note'}]) AS i)), "
        "shape AS (SELECT sheet_id, count(*) AS n_cols FROM headers GROUP BY 1), sizes AS (SELECT sheet_id, count(*) AS n_rows FROM sheet GROUP BY 1)"
    )
    scores = o.scores_cte(width).replace(
        "dist AS (SELECT sheet_id, filled_cells, n_incomplete, high + (hfill >= 0.8)::INT AS high,\n"
        "  medium + (hfill >= 0.5 AND hfill < 0.8)::INT AS medium, low + (hfill < 0.5)::INT AS low\n"
        "  FROM rdist JOIN heads USING (sheet_id))",
        "dist AS (SELECT sheet_id, filled_cells, n_incomplete, high + 1 + (hr > 0)::INT AS high, medium, low FROM rdist JOIN h USING (sheet_id))",
    )
    scores = scores.replace("multi AS (", "multi AS (").replace("FROM base)", "FROM (SELECT * REPLACE (np AS np), (hr > 0)::INT AS merged_title FROM base JOIN h USING (sheet_id)))", 1)
    scores = scores.replace("greatest(0, 100.0 - mh::INT * 20", "greatest(0, 100.0 - merged_title * 20 - mh::INT * 20", 1)
    return f"{sheet}, {o.cells_cte(width)}, {o.facts_cte()}, {o.profile_cte()}, {o.rows_cte(width)}, {o.near_cte()}, {scores}"


@register(
    f"{_batch_sql()} SELECT sheet_id, n_rows, high::BIGINT AS high, medium::BIGINT AS medium, low::BIGINT AS low, {SCORES_OUT}, total_score, {STATUS_SQL} FROM scored"
)
def assessment_many_sheets(spark, d):
    grid, merged, _ = customer_grid(spark, d)
    return score_columns(assess(gr.sheets_from_grid(grid, merged)).scores)


@register(f"{o.sheets_cte('customers')} SELECT row_idx, c0, c1, c2, coalesce(c3, '') AS c3 FROM sheet")
def csv_round_trip(spark, d):

    path = f"{shared_folder(spark)}/tidegrid/csv-{uuid.uuid4().hex}"
    csvio.write_refined_csv(sheets(spark, d, "customers"), path)
    return csvio.read_csv_parts(spark, path, "customers").rows.drop("sheet_id")


WIDE_COLUMNS = 300


def _written_lines(spark, rows: DataFrame, line: Column, header: str, rows_of_file: int) -> str:
    """A folder of text files that hold the lines of (k, ..) in the order of k after a header line; one CSV sheet cut into files.

    Rows are put in order before their lines are made, so the lines are not shuffled; files follow from the number of rows.
    """

    path = f"{shared_folder(spark)}/tidegrid/csv-{uuid.uuid4().hex}"
    head = spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(True).alias("is_head"))
    files = max(spark.sparkContext.defaultParallelism, -(-rows.count() // rows_of_file))
    ordered = head.unionByName(rows.withColumn("is_head", F.lit(False)), allowMissingColumns=True).repartitionByRange(
        files, "k").sortWithinPartitions("k")
    ordered.select(F.when(F.col("is_head"), F.lit(header)).otherwise(line).alias("line")).write.text(path)
    return path


@register(
    f"SELECT (row_number() OVER (PARTITION BY i ORDER BY c_custkey) - 1)::BIGINT AS row_idx, i::INT AS col_idx, CASE i % 7 "
    f"WHEN 0 THEN c_name || ', \"' || i || '\"' || chr(10) || 'x' WHEN 1 THEN c_name || '\"' || i || '\"' "
    f"WHEN 2 THEN 'a\"b' || c_mktsegment ELSE c_name || i END AS raw FROM customer, range({WIDE_COLUMNS}) r(i)"
)
def csv_wide(spark, d):
    """300 columns with quoted separators, quotes and line breaks, and stray quotes, keep all of them; many tasks."""
    def cell(i: int) -> Column:
        return (F.concat(F.lit('"'), "c_name", F.lit(f', ""{i}""\nx"')), F.concat("c_name", F.lit(f'"{i}"')),
                F.concat(F.lit('"a"b'), "c_mktsegment", F.lit('"')))[i % 7] if i % 7 < 3 else F.concat("c_name", F.lit(str(i)))

    t = load(spark, d, "customer")
    line = F.concat_ws(",", *[cell(i) for i in range(WIDE_COLUMNS)])
    rows = t.select(F.col("c_custkey").cast("long").alias("k"), "c_name", "c_mktsegment")
    path = _written_lines(spark, rows, line, ",".join(f"h{i}" for i in range(WIDE_COLUMNS)), 20_000)
    return csvio.read_csv_sheet(spark, path, "wide").cells().select("row_idx", "col_idx", "raw")


@register(
    "SELECT 'empty-' || n_nationkey AS sheet_id, 0::BIGINT AS n_rows, 1::BIGINT AS high, 0::BIGINT AS medium, 0::BIGINT AS low, 0.0 AS row_completeness, "
    "0.0 AS column_completeness, 100.0 AS format_consistency, 100.0 AS duplicate_similar, 100.0 AS table_structure, 0.0 AS ai_query_readiness, "
    # 60 % weighted indicators, 40 % share of well filled rows: the header row is the only row.
    "round((0.6 * 100 * {w} + 0.4 * 100) * 10) / 10 AS total_score, 'conditional' AS status FROM nation".replace(
        "{w}", str(sum(lx.DEFAULT_WEIGHTS[k] for k in ("format_consistency", "duplicate_similar", "table_structure"))))
)
def assessment_header_only(spark, d):
    """One sheet per nation that has a header row and no data."""
    t = load(spark, d, "nation").withColumn("sheet_id", F.concat(F.lit("empty-"), F.col("n_nationkey").cast("string")))
    headers = t.select("sheet_id", F.posexplode(F.array(F.lit("id"), F.col("n_name"))).alias("col_idx", "name"))
    rows = t.select("sheet_id", F.lit(0).cast("long").alias("row_idx"), *[F.lit(None).cast("string").alias(c) for c in ("c0", "c1")]).filter(F.col("row_idx") < 0)
    return score_columns(assess(Sheets(rows, headers, 2)).scores)


UPLOADS_SQL = (
    "WITH up AS (SELECT o_orderkey AS id, o_custkey AS upload_id, o_orderdate AS created_at, c_nationkey AS user_id, c_name || '.v1.xlsx' AS filename "
    "FROM orders JOIN customer ON o_custkey = c_custkey)"
)


@register(
    f"{UPLOADS_SQL} SELECT id, upload_id, created_at, user_id, filename, (SELECT count(*) FROM up WHERE user_id = 3) AS total "
    "FROM up WHERE user_id = 3 ORDER BY created_at DESC, id LIMIT 25 OFFSET 25"
)
def user_history(spark, d):
    made, files = as_uploads(spark, d)
    return us.user_history(made, files, 3, page=2, size=25)


@register(f"{UPLOADS_SQL} SELECT id, upload_id, created_at, user_id, filename FROM up WHERE id = 7 AND user_id = (SELECT max(user_id) FROM up WHERE id = 7)")
def owned_row(spark, d):
    made, files = as_uploads(spark, d)
    every = us.user_assessments(made, files)
    owner = every.filter("id = 7").agg(F.max("user_id")).first()[0]
    return us.owned_by(every, 7, owner)


@register(
    f"{TRANSLATIONS_SQL}, u AS (SELECT locale, key, arg_max(value, updated_at) AS value, max(updated_at) AS updated_at FROM t GROUP BY ALL), "
    "f AS (SELECT * FROM u WHERE key ILIKE '%7%' OR value ILIKE '%7%') "
    "SELECT locale, key, value, updated_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY key, locale LIMIT 20 OFFSET 20"
)
def translation_page(spark, d):
    t = translations(spark, d)
    return us.translation_page(us.upsert(t, t.limit(0), ["locale", "key"], "updated_at"), None, "7", page=2)


@register(
    "SELECT o_orderkey::VARCHAR AS sheet_id, printf('%.1f → %.1f (%s%.1f)', b, a, CASE WHEN a - b >= 0 THEN '+' ELSE '' END, a - b) AS indicator, "
    "printf('%.1f (%s%.1f)', b, CASE WHEN a - b >= 0 THEN '+' ELSE '' END, a - b) AS total "
    "FROM (SELECT o_orderkey, (o_orderkey % 101)::DOUBLE AS b, (o_custkey % 97)::DOUBLE AS a FROM orders)"
)
def compare_labels(spark, d):
    """Labels of score changes; scores are derived from the keys."""
    b, a = (F.col(c).cast("double") for c in ("b", "a"))
    t = load(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("sheet_id"), (F.col("o_orderkey") % 101).alias("b"), (F.col("o_custkey") % 97).alias("a"))
    return t.select("sheet_id", cp.indicator_label(b, a).alias("indicator"), cp.score_label(b, a).alias("total"))


@register(
    "SELECT path, violation FROM (SELECT c_name || ext AS path, unnest(list_filter(["
    "CASE WHEN ext NOT IN ('.csv', '.XLSX') THEN 'unsupported_format' END, CASE WHEN len > 52428800 THEN 'file_too_large' END, "
    "CASE WHEN rows > 100000 THEN 'too_many_rows' END, CASE WHEN sel = 'Gone' THEN 'sheet_not_found' END], lambda x: x IS NOT NULL)) AS violation "
    "FROM (SELECT c_name, ['.csv', '.XLSX', '.pdf'][c_custkey % 3 + 1] AS ext, c_custkey * 100000 AS len, c_custkey * 200 AS rows, "
    "CASE WHEN c_custkey % 4 = 0 THEN 'Gone' WHEN c_custkey % 4 = 1 THEN 'A' END AS sel FROM customer))"
)
def upload_violations(spark, d):
    k = F.col("c_custkey")
    files = load(spark, d, "customer").select(
        F.concat("c_name", F.when(k % 3 == 0, ".csv").when(k % 3 == 1, ".XLSX").otherwise(".pdf")).alias("path"),
        (k * 100000).alias("length"), (k * 200).alias("row_count"), F.array(F.lit("A"), F.lit("B")).alias("sheets"),
        F.when(k % 4 == 0, "Gone").when(k % 4 == 1, "A").alias("selected"))
    return csvio.validate_files(files)


@register("SELECT 'Sheet1' AS sheet, count(*) + 1 AS row_count, 5::INT AS col_count, count(*) > 100000 AS too_many_rows FROM orders")
def csv_metadata(spark, d):
    """Ragged records, empty lines, line breaks in quotes and stray quotes."""
    k = F.col("k")
    line = F.concat(
        F.when(k % 5 == 0, F.lit('\n\n')).otherwise(F.lit("")), k.cast("string"), F.lit(',"'), "o_orderstatus", F.lit('\n\n,""'),
        F.col("o_totalprice").cast("string"), F.lit('"",",'), F.when(k % 3 == 0, F.lit('p"q')).otherwise(F.lit("")),
        F.when(k % 2 == 0, F.lit(',"r"s",')).otherwise(F.lit("")))
    rows = load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), "o_orderstatus", "o_totalprice")
    path = _written_lines(spark, rows, line, "key,clerk", 1_000_000)
    return csvio.csv_metadata(spark, path)


@register(
    f"{o.sheets_cte('documents')}, {o.cells_cte(o.width_of('documents'))} SELECT sheet_id, col_idx, raw AS value, count(*) AS n, min(row_idx) AS first_row FROM cells GROUP BY ALL"
)
def first_seen_values(spark, d):
    """Distinct values of the document sheet, long ones as whole texts."""
    s = sheets(spark, d, "documents")
    return pf.first_seen_values(s, materialize(pf.value_counts(s)))
