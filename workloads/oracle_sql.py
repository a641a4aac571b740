"""SQL building blocks for the DuckDB counterparts of the queries."""

from __future__ import annotations

from workloads.dirty import SHEETS

TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
DATE = (
    r"^\d{4}[/-](0?[1-9]|1[0-2])[/-](0?[1-9]|[12]\d|3[01])$"
    r"|^\d{2,3}\.(0?[1-9]|1[0-2])\.(0?[1-9]|[12]\d|3[01])$"
)
NUMERIC = r"^-?\d+$|^-?\d{1,3}(,\d{3})+$|^-?(\d+\.\d*|\.\d+)$|^-?\d{1,3}(,\d{3})+\.\d+$"


def trim(x: str) -> str:
    return TRIM.format(x=x)


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def parses(x: str) -> str:
    number = matches(x, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    word = matches(f"lower({x})", "^([+-]?(inf|infinity)|nan)$")
    return (
        f"coalesce(({number} AND abs(TRY_CAST({x} AS DOUBLE)) < 'inf'::DOUBLE) OR {word}, false)"
    )


def is_num(v: str) -> str:
    return parses(f"replace({v}, ',', '')")


def is_currency(v: str) -> str:
    cut = (
        f"CASE WHEN starts_with({v}, 'NT$') OR starts_with({v}, 'USD') "
        f"THEN {trim(f'substr({v}, 4)')} ELSE {v} END"
    )
    bare = trim(f"trim({cut}, '$¥€')")
    return parses(f"replace({bare}, ',', '')")


def date_like(v: str) -> str:
    return (
        f"(strlen({v}) BETWEEN 6 AND 12 AND length(regexp_replace({v}, '[^0-9]', '', 'g')) >= 4 "
        f"AND length(regexp_replace({v}, '[^-/.]', '', 'g')) >= 2)"
    )


def is_placeholder(v: str) -> str:
    return matches(v, r"(?i)^(同\s*|same\s+as\s+)[A-Za-z]+\d+$")


def has_note(x: str) -> str:
    return matches(x, "^[^(（]*[(（][^)）]*[一-鿿][^)）]*[)）]")


def is_remark(inner: str) -> str:
    t = trim(inner)
    return (
        f"CASE WHEN {t} = '' THEN false WHEN {matches(t, '[一-鿿]')} THEN true "
        f"WHEN {matches(t, '^[vV][0-9]+$')} OR {matches(t, '^[0-9.,]+$')} THEN false "
        f"ELSE length({t}) > 5 END"
    )


def has_remark(x: str) -> str:
    closed = f"regexp_extract({x}, '^([^(（]*(\\([^)]*\\)|（[^）]*）))*', 0)"
    pairs = f"regexp_extract_all({closed}, '\\([^)]*\\)|（[^）]*）')"
    return f"(len([m for m in {pairs} if {is_remark('substr(m, 2, length(m) - 2)')}]) > 0)"


def is_subtotal(x: str) -> str:
    return matches(f"lower({x})", "小計|合計|total")


def normal_date(v: str) -> str:
    def ymd(y: str, m: str, d: str) -> str:
        return (
            f"strftime(TRY_CAST(({y}) || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') "
            f"AS DATE), '%Y/%m/%d')"
        )

    def g(p: str, i: int) -> str:
        return f"regexp_extract({v}, '{p}', {i})"

    slash, dash = r"^(\d{4})/(\d{1,2})/(\d{1,2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    roc, mdy = r"^(\d{2,3})\.(\d{1,2})\.(\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2})$"
    roc_year = f"CAST(CAST({g(roc, 1)} AS INT) + 1911 AS VARCHAR)"
    yy = f"CAST({g(mdy, 3)} AS INT)"
    year = f"CAST({yy} + CASE WHEN {yy} < 50 THEN 2000 ELSE 1900 END AS VARCHAR)"
    return (
        f"CASE WHEN {matches(v, slash)} THEN {ymd(g(slash, 1), g(slash, 2), g(slash, 3))} "
        f"WHEN {matches(v, dash)} THEN {ymd(g(dash, 1), g(dash, 2), g(dash, 3))} "
        f"WHEN {matches(v, roc)} THEN {ymd(roc_year, g(roc, 2), g(roc, 3))} "
        f"WHEN {matches(v, mdy)} THEN {ymd(year, g(mdy, 1), g(mdy, 2))} END"
    )


def entity_key(v: str) -> str:
    stem = f"regexp_replace({v}, '(股份有限公司|有限公司|公司|Company|Corp\\.|Inc\\.|Ltd\\.|Co\\.)$', '')"
    return f"lower({trim(stem)})"


def sheets_cte(*names: str) -> str:
    """sheet(sheet_id, row_idx, c0..cK) and headers(sheet_id, col_idx, name)."""
    width = max(len(SHEETS[n][2]) for n in names)
    parts, heads = [], []
    for n in names:
        _, sql, headers = SHEETS[n]
        cols = [f"c{i}" if i < len(headers) else f"NULL::VARCHAR AS c{i}" for i in range(width)]
        parts.append(f"SELECT '{n}' AS sheet_id, row_idx, {', '.join(cols)} FROM ({sql})")
        heads += [f"('{n}', {i}, '{h}')" for i, h in enumerate(headers)]
    return (
        f"WITH sheet AS ({' UNION ALL '.join(parts)}), "
        f"headers(sheet_id, col_idx, name) AS (VALUES {', '.join(heads)}), "
        f"shape AS (SELECT sheet_id, count(*) AS n_cols FROM headers GROUP BY 1), "
        f"sizes AS (SELECT sheet_id, count(*) AS n_rows FROM sheet GROUP BY 1)"
    )


def cells_cte(width: int) -> str:
    parts = [
        f"SELECT sheet_id, row_idx, {i} AS col_idx, c{i} AS raw, {trim(f'c{i}')} AS v FROM sheet"
        for i in range(width)
    ]
    return f"cells AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE v <> '')"


def width_of(*names: str) -> int:
    return max(len(SHEETS[n][2]) for n in names)


FACT_SQL = {
    "date": matches("v", DATE),
    "num": matches("v", NUMERIC),
    "bool": "lower(v) IN ('true', 'false', '是', '否', 'y', 'n', 'yes', 'no')",
    "parse": is_num("v"),
    "numcur": is_currency("v"),
    "ident": matches("v", r"^[A-Za-z0-9\-_]+[A-Za-z0-9\-_.]*$"),
    "remark": has_remark("raw"),
    "note": has_note("raw"),
    "newline": "contains(raw, chr(10))",
    "placeholder": is_placeholder("v"),
    "datelike": date_like("v"),
    "normdate": f"({normal_date('v')}) IS NOT NULL",
    "subtotal": is_subtotal("raw"),
}


def facts_cte() -> str:
    flags = ", ".join(f"({sql}) AS is_{k}" for k, sql in FACT_SQL.items())
    return (
        f"facts AS (SELECT *, CASE WHEN is_date THEN 'DATE' WHEN is_num THEN 'NUMERIC' "
        f"WHEN is_bool THEN 'BOOLEAN' ELSE 'TEXT' END AS fmt, length(raw) AS n_chars "
        f"FROM (SELECT *, {flags} FROM cells))"
    )


def profile_cte() -> str:
    """prof: counts per sheet column; flags: the classifications."""
    plain = ["parse", "numcur", "ident", "remark", "note", "newline", "placeholder", "datelike",
             "normdate", "subtotal"]
    counts = ", ".join(f"count(*) FILTER (WHERE is_{k}) AS n_{k}" for k in plain)
    return f"""
freq AS (SELECT sheet_id, col_idx, raw, count(*) AS n FROM cells GROUP BY ALL),
uniq AS (SELECT sheet_id, col_idx, count(*) AS n_distinct, max(n) AS max_freq FROM freq GROUP BY ALL),
agg AS (SELECT sheet_id, col_idx, count(*) AS n_nonempty, {counts},
  count(*) FILTER (WHERE fmt = 'DATE') AS n_date, count(*) FILTER (WHERE fmt = 'NUMERIC') AS n_num,
  count(*) FILTER (WHERE fmt = 'BOOLEAN') AS n_bool, count(*) FILTER (WHERE fmt = 'TEXT') AS n_text,
  count(*) FILTER (WHERE fmt = 'DATE' AND row_idx < 100) AS n_date_first100,
  count(*) FILTER (WHERE fmt = 'DATE' OR is_datelike) AS n_anydate,
  avg(n_chars) FILTER (WHERE fmt = 'TEXT') AS len_avg,
  stddev_pop(n_chars) FILTER (WHERE fmt = 'TEXT') AS len_std,
  bool_or(NOT is_parse AND is_note) AS has_note_in_number
  FROM facts GROUP BY ALL),
prof AS (SELECT h.sheet_id, h.col_idx, h.name, z.n_rows,
  coalesce(n_nonempty, 0) AS n_nonempty, coalesce(n_nonempty - n_placeholder, 0) AS n_valid,
  coalesce(n_distinct, 0) AS n_distinct, coalesce(max_freq, 0) AS max_freq,
  {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in plain + ['date', 'num', 'bool', 'text', 'date_first100', 'anydate'])},
  len_avg, len_std, coalesce(has_note_in_number, false) AS has_note_in_number
  FROM headers h JOIN sizes z USING (sheet_id)
  LEFT JOIN agg a ON a.sheet_id = h.sheet_id AND a.col_idx = h.col_idx
  LEFT JOIN uniq u ON u.sheet_id = h.sheet_id AND u.col_idx = h.col_idx),
flags AS (SELECT *, n_valid / n_rows AS valid_ratio, n_nonempty / n_rows AS fill_ratio,
  CASE WHEN n_nonempty > 0 THEN greatest(n_date, n_num, n_bool, n_text) / n_nonempty END AS consistency,
  coalesce(n_distinct / nullif(n_nonempty, 0) > 0.8, false) AS is_identifier,
  n_date_first100 / least(n_rows, 100) > 0.6 AS is_time,
  n_distinct > 1 AND n_distinct < n_rows * 0.2 AS is_category,
  coalesce(n_parse / nullif(n_nonempty, 0) > 0.8, false) AS is_numeric,
  coalesce(n_numcur / nullif(n_nonempty, 0) > 0.7, false) AS is_mostly_numeric,
  CASE WHEN n_numcur / nullif(n_nonempty, 0) > 0.7 THEN n_nonempty - n_numcur ELSE 0 END AS n_mismatch,
  coalesce(n_ident / nullif(n_nonempty, 0) > 0.6, false) AS is_structured,
  coalesce(n_ident / nullif(n_nonempty, 0) > 0.6 AND n_remark / nullif(n_nonempty, 0) > 0.2, false) AS is_remark_dense,
  coalesce(n_anydate / nullif(n_nonempty, 0) > 0.3, false) AS is_date_display,
  coalesce(n_normdate / nullif(n_nonempty, 0) > 0.5, false) AS is_date_cleaning,
  coalesce((n_nonempty - n_parse) / nullif(n_nonempty, 0) > 0.5, false) AS is_text_cleaning,
  coalesce(n_nonempty > 5 AND n_newline / n_nonempty > 0.1, false) AS is_newline_heavy,
  coalesce((n_text / nullif(n_nonempty, 0) >= 0.5 AND n_text > 0 AND len_std > len_avg * 3)
    OR (n_parse / nullif(n_nonempty, 0) > 0.6 AND has_note_in_number)
    OR (n_nonempty > 10 AND n_note / n_nonempty > 0.1 AND n_note / n_nonempty < 0.8), false) AS has_notes,
  coalesce(n_nonempty > 0 AND n_text / n_nonempty >= 0.3 AND n_date / n_nonempty <= 0.5
    AND n_datelike / n_nonempty <= 0.5 AND max_freq / n_rows <= 0.05 AND n_distinct > 10
    AND n_distinct / n_nonempty <= 0.8 AND n_distinct / n_rows > 0.01 AND n_distinct / n_rows < 0.95,
    false) AS is_near_dup_candidate
  FROM prof)"""


def rows_cte(width: int) -> str:
    """fill: filled cells per row and the joined row text; blank runs and their edges."""
    filled = " + ".join(
        f"CASE WHEN coalesce({trim(f'c{i}')}, '') <> '' THEN 1 ELSE 0 END" for i in range(width)
    )
    text = " || ".join(f"coalesce(c{i}, '') || '|'" for i in range(width))
    return f"""
fill AS (SELECT sheet_id, row_idx, n_cols, {filled} AS n_filled, {text} AS row_text
  FROM sheet JOIN shape USING (sheet_id)),
bounds AS (SELECT sheet_id, count(*) AS n_rows, min(row_idx) FILTER (WHERE n_filled > 0) AS first_data,
  max(row_idx) FILTER (WHERE n_filled > 0) AS last_data FROM fill GROUP BY 1),
isl AS (SELECT sheet_id, row_idx, row_idx - row_number() OVER (PARTITION BY sheet_id ORDER BY row_idx) AS grp
  FROM fill WHERE n_filled = 0),
gaps AS (SELECT sheet_id, min(row_idx) AS gap_start, max(row_idx) AS gap_end FROM isl
  GROUP BY sheet_id, grp HAVING count(*) >= 2),
edges AS (SELECT sheet_id, min(gap_end) AS first_end, max(gap_start) AS last_start FROM gaps GROUP BY 1),
gapsum AS (SELECT b.*, CASE WHEN first_end + 1 <= last_data THEN first_end + 1 END AS post_gap,
  coalesce(last_start > first_data, false) AS has_multiple_tables
  FROM bounds b LEFT JOIN edges e USING (sheet_id))"""


def near_cte() -> str:
    # DuckDB's levenshtein counts bytes, the rule counts characters: the CJK
    # letters of the derived names are replaced by one-byte signs first.
    def one_byte(x: str) -> str:
        return f"translate({x}, '台灣科技股份有限公司', '!@#%^&*~`|')"

    return f"""
cand AS (SELECT sheet_id, col_idx FROM flags WHERE is_near_dup_candidate
  QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY col_idx) <= 5),
vals AS (SELECT c.sheet_id, c.col_idx, c.raw, min(c.row_idx) AS first_row
  FROM cells c SEMI JOIN cand d ON c.sheet_id = d.sheet_id AND c.col_idx = d.col_idx
  WHERE length(c.raw) > 3 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, col_idx ORDER BY first_row) AS rn FROM vals
  QUALIFY rn <= 200),
pairs AS (SELECT a.sheet_id, a.col_idx, a.rn AS rank1, b.rn AS rank2, a.raw AS value1, b.raw AS value2,
  a.first_row AS row1, b.first_row AS row2
  FROM ranked a JOIN ranked b ON a.sheet_id = b.sheet_id AND a.col_idx = b.col_idx AND a.rn < b.rn
  WHERE abs(length(a.raw) - length(b.raw)) <= 2 AND levenshtein({one_byte('a.raw')}, {one_byte('b.raw')}) <= 2)"""


def all_near_cte() -> str:
    """allpairs: the near pairs of every value of every eligible column, by brute force."""
    def one_byte(x: str) -> str:  # as in near_cte
        return f"translate({x}, '台灣科技股份有限公司', '!@#%^&*~`|')"

    return f"""
allvals AS (SELECT c.sheet_id, c.col_idx, c.raw, min(c.row_idx) AS first_row
  FROM cells c SEMI JOIN (SELECT * FROM flags WHERE is_near_dup_candidate) d
  ON c.sheet_id = d.sheet_id AND c.col_idx = d.col_idx WHERE length(c.raw) > 3 GROUP BY ALL),
allpairs AS (SELECT a.sheet_id, a.col_idx, a.first_row AS row1, b.first_row AS row2
  FROM allvals a JOIN allvals b ON a.sheet_id = b.sheet_id AND a.col_idx = b.col_idx AND a.first_row < b.first_row
  WHERE abs(length(a.raw) - length(b.raw)) <= 2 AND levenshtein({one_byte('a.raw')}, {one_byte('b.raw')}) <= 2)"""


def scores_cte(width: int) -> str:
    """Everything up to ``scored``: the six indicators with issue penalties and the total."""
    header_like = " UNION ALL ".join(
        f"SELECT sheet_id, row_idx, {i} AS col_idx, c{i} AS raw FROM sheet WHERE row_idx < 5" for i in range(width)
    )
    return f"""
toprows AS (SELECT t.sheet_id, t.row_idx, bool_and(f.fmt = 'TEXT') AND count(DISTINCT lower(f.v)) = count(*) AS is_head
  FROM ({header_like}) t JOIN facts f USING (sheet_id, row_idx, col_idx) GROUP BY ALL),
multi AS (SELECT sheet_id, count(*) FILTER (WHERE is_head) > 1 AS has_multi_header FROM toprows GROUP BY 1),
orph AS (SELECT f.sheet_id, count(DISTINCT f.row_idx) AS n_orphans FROM fill f JOIN gapsum g USING (sheet_id)
  JOIN facts x ON x.sheet_id = f.sheet_id AND x.row_idx = f.row_idx AND x.is_parse
  WHERE f.n_filled BETWEEN 1 AND 2 AND f.row_idx >= g.post_gap GROUP BY 1),
roll AS (SELECT sheet_id, avg(valid_ratio) AS avg_valid, avg(consistency) AS avg_consistency,
  sum(n_nonempty) AS ne, sum(n_valid) AS nv, sum(n_placeholder) AS np, sum(n_mismatch) AS nm,
  sum(n_subtotal) > 0 AS has_subtotal, bool_or(is_identifier) AS ident, bool_or(is_time) AS tim,
  bool_or(is_category) AS cat, bool_or(is_numeric) AS numc, bool_or(is_newline_heavy) AS nl,
  bool_or(has_notes) AS notes, bool_or(is_remark_dense) AS dense FROM flags GROUP BY 1),
heads AS (SELECT sheet_id, bool_and(length(trim(name)) > 1) AND count(DISTINCT lower(trim(name))) = count(*) AS good,
  bool_or(trim(name) = '') AS blank_head, count(*) FILTER (WHERE trim(name) <> '') / count(*) AS hfill
  FROM headers GROUP BY 1),
dups AS (SELECT sheet_id, sum(n - 1) AS n_exact FROM (SELECT sheet_id,
  CASE WHEN n_filled = 0 THEN '' ELSE row_text END AS k, n_filled = 0 AS b, count(*) AS n FROM fill GROUP BY ALL)
  GROUP BY 1),
rdist AS (SELECT sheet_id, sum(n_filled) AS filled_cells, count(*) FILTER (WHERE n_filled < n_cols) AS n_incomplete,
  count(*) FILTER (WHERE n_filled / n_cols >= 0.8) AS high,
  count(*) FILTER (WHERE n_filled / n_cols >= 0.5 AND n_filled / n_cols < 0.8) AS medium,
  count(*) FILTER (WHERE n_filled / n_cols < 0.5) AS low FROM fill GROUP BY 1),
dist AS (SELECT sheet_id, filled_cells, n_incomplete, high + (hfill >= 0.8)::INT AS high,
  medium + (hfill >= 0.5 AND hfill < 0.8)::INT AS medium, low + (hfill < 0.5)::INT AS low
  FROM rdist JOIN heads USING (sheet_id)),
nears AS (SELECT sheet_id, count(*) AS n_near FROM pairs GROUP BY 1),
base AS (SELECT g.sheet_id, g.n_rows, s.n_cols, g.has_multiple_tables, coalesce(m.has_multi_header, false) AS mh,
  coalesce(o.n_orphans, 0) AS n_orphans, r.*, h.good, h.blank_head, d.*, x.n_exact, coalesce(n.n_near, 0) AS n_near,
  (g.n_rows * s.n_cols)::DOUBLE AS cells
  FROM gapsum g JOIN shape s USING (sheet_id) JOIN roll r USING (sheet_id) JOIN heads h USING (sheet_id)
  JOIN dist d USING (sheet_id) JOIN dups x USING (sheet_id) LEFT JOIN multi m USING (sheet_id)
  LEFT JOIN orph o USING (sheet_id) LEFT JOIN nears n USING (sheet_id)),
ind AS (SELECT *, nv / cells * 100 AS row_completeness, avg_valid * 100 AS column_completeness,
  greatest(0, coalesce(avg_consistency * 100, 100) * (1 - least(1, (np * 5.0 + nm * 3.0) / ne))) AS format_consistency,
  round((1 - (cells - filled_cells) / cells)
    * greatest(0, 1 - (n_exact + least(n_near, n_rows) * 0.5) / n_rows) * 100 * 10) / 10 AS duplicate_similar,
  greatest(0, 100.0 - mh::INT * 20 - has_subtotal::INT * 15 - has_multiple_tables::INT * 25 - notes::INT * 10
    - nl::INT * 5 - (n_orphans > 0 AND NOT has_subtotal)::INT * 20 - (dense AND NOT notes)::INT * 15)::DOUBLE AS table_structure,
  greatest(0, (ident::INT + tim::INT + cat::INT + numc::INT + (good AND NOT blank_head)::INT) * 20
    - least(30, np / cells * 600) - dense::INT * 15)::DOUBLE AS ai_query_readiness FROM base),
scored AS (SELECT *, round(((row_completeness * 0.25::DOUBLE + column_completeness * 0.25::DOUBLE + format_consistency * 0.15::DOUBLE
  + duplicate_similar * 0.1::DOUBLE + table_structure * 0.1::DOUBLE + ai_query_readiness * 0.15::DOUBLE) * 0.6::DOUBLE
  + high / (high + medium + low) * 100 * 0.4::DOUBLE) * 10) / 10 AS total_score FROM ind)"""
