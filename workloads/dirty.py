"""Deterministic defects for the clean supplied tables.

Each sheet is one SELECT whose text is valid in Spark SQL and in DuckDB, so a
query and its SQL counterpart read exactly the same cells. Columns are named
c0..cN next to the dense key ``row_idx``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.session import materialize
from tidegrid.sheet import Sheets, header_table, spread

ORDERS_HEADERS = [
    "Order ID", "Customer", "Amount", "Order Date", "Status", "Ref No.", "Memo", "", "Priority",
]
# Blank gaps, single blanks, orphan totals, subtotal rows and repeated rows are
# whole-row defects; the rest are cell defects.
ORDERS_SQL = """
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_orderstatus AS st, o_orderpriority AS pr,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS amt,
         CAST(CAST(o_orderdate AS DATE) AS STRING) AS d,
         CASE WHEN o_orderkey % 1000 IN (700, 701, 702, 850) THEN 'blank'
              WHEN o_orderkey % 1000 = 703 THEN 'orphan'
              WHEN o_orderkey % 333 = 7 THEN 'subtotal'
              WHEN o_orderkey % 50 = 3 THEN 'copy'
              ELSE 'data' END AS kind
  FROM orders
), parts AS (
  SELECT k, ck, st, pr, amt, kind, d,
         CAST(CAST(substring(d, 1, 4) AS INT) - 1911 AS STRING) AS roc,
         CAST(CAST(substring(d, 6, 2) AS INT) AS STRING) AS mo,
         CAST(CAST(substring(d, 9, 2) AS INT) AS STRING) AS dy
  FROM base
)
SELECT k AS row_idx,
  CASE WHEN kind IN ('blank', 'orphan', 'subtotal') THEN ''
       WHEN kind = 'copy' THEN 'ORD-COPY-' || CAST(CAST(floor(k / 500) AS BIGINT) AS STRING)
       ELSE 'ORD-' || lpad(CAST(k AS STRING), 8, '0') END AS c0,
  CASE WHEN kind = 'blank' THEN '' WHEN kind = 'orphan' THEN NULL
       WHEN kind = 'subtotal' THEN '小計' WHEN kind = 'copy' THEN 'Copy Trading Ltd.'
       WHEN k % 5 = 0 THEN 'Acme ' || CAST(ck AS STRING) || ' Co.'
       WHEN k % 5 = 1 THEN 'ACME ' || CAST(ck AS STRING) || ' Corp.'
       WHEN k % 5 = 2 THEN 'Acme ' || CAST(ck AS STRING)
       ELSE ' Acme ' || CAST(ck AS STRING) || ' Company' END AS c1,
  CASE WHEN kind = 'blank' THEN '' WHEN kind = 'copy' THEN '100.00'
       WHEN kind <> 'data' THEN amt
       WHEN k % 211 = 4 THEN '同AH' || CAST(k % 9 + 1 AS STRING)
       WHEN k % 389 = 11 THEN 'same as B3'
       WHEN k % 43 = 7 THEN '三萬'
       WHEN k % 37 = 5 THEN 'NT$ ' || amt
       WHEN k % 41 = 6 THEN 'USD' || amt
       WHEN k % 47 = 8 THEN '$1,234.56'
       WHEN k % 101 = 9 THEN '1e400'
       WHEN k % 103 = 10 THEN '12d'
       ELSE amt END AS c2,
  CASE WHEN kind IN ('blank', 'orphan', 'subtotal') THEN NULL WHEN kind = 'copy' THEN '2024/01/15'
       WHEN k % 53 = 9 THEN 'unknown'
       WHEN k % 59 = 1 THEN '2023-02-30'
       WHEN k % 8 < 4 THEN d
       WHEN k % 8 < 6 THEN roc || '.' || mo || '.' || dy
       WHEN k % 8 = 6 THEN mo || '/' || dy || '/' || substring(d, 3, 2)
       ELSE replace(d, '-', '/') END AS c3,
  CASE WHEN kind IN ('blank', 'orphan', 'subtotal') THEN '' WHEN kind = 'copy' THEN '完成'
       WHEN k % 3 = 1 THEN NULL WHEN k % 7 = 4 THEN '  ' WHEN k % 23 = 9 THEN '　'
       WHEN st = 'F' THEN '完成' WHEN st = 'O' THEN 'yes' ELSE '取消' END AS c4,
  CASE WHEN kind IN ('blank', 'orphan', 'subtotal') THEN '' WHEN kind = 'copy' THEN 'PI-0'
       WHEN k % 4 = 1 THEN 'PI-' || CAST(k AS STRING) || '(IQC檢測CPU)'
       WHEN k % 31 = 3 THEN 'PI-' || CAST(k AS STRING) || '(v2)'
       WHEN k % 31 = 6 THEN 'PI-' || CAST(k AS STRING) || '(abcdef)'
       WHEN k % 31 = 9 THEN '(A)PI（備註）-' || CAST(k AS STRING)
       WHEN k % 31 = 12 THEN 'PI-' || CAST(k AS STRING) || '(abc（中文）'
       ELSE 'PI-' || CAST(k AS STRING) END AS c5,
  CASE WHEN kind <> 'data' THEN NULL
       WHEN k % 20 = 5 THEN 'first line' || chr(10) || 'second line'
       WHEN k % 20 = 6 THEN 'checked' ELSE NULL END AS c6,
  CASE WHEN kind = 'data' AND k % 2 = 0 THEN CAST(k % 7 AS STRING) ELSE '' END AS c7,
  CASE WHEN kind IN ('blank', 'orphan', 'subtotal') THEN '' WHEN kind = 'copy' THEN '1-URGENT'
       ELSE pr END AS c8
FROM parts
"""

CUSTOMERS_HEADERS = ["編號", "客戶名稱", "Balance", "Segment"]
CUSTOMERS_SQL = """
SELECT c_custkey AS row_idx,
  'C-' || CAST(c_custkey AS STRING) AS c0,
  CASE WHEN c_custkey % 9 = 0 THEN '台灣科技' || CAST(c_custkey % 40 AS STRING) || '股份有限公司'
       WHEN c_custkey % 9 IN (1, 2) THEN '台灣科技' || CAST(c_custkey % 40 AS STRING) || '有限公司'
       WHEN c_custkey % 9 = 3 THEN '台灣科技' || CAST(c_custkey % 40 AS STRING)
       WHEN c_custkey % 9 = 4 THEN 'Initech ' || CAST(c_custkey % 30 AS STRING) || ' Inc.'
       WHEN c_custkey % 9 = 5 THEN 'INITECH ' || CAST(c_custkey % 30 AS STRING)
       ELSE c_name END AS c1,
  CASE WHEN c_custkey % 6 = 0 THEN 'NT$' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING)
       WHEN c_custkey % 6 = 1 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) || '€'
       WHEN c_custkey % 13 = 2 THEN 'pending' WHEN c_custkey % 17 = 3 THEN ''
       ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END AS c2,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS c3
FROM customer
"""

PARTS_HEADERS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PARTS_SQL = """
SELECT p_partkey AS row_idx, CAST(p_partkey AS STRING) AS c0,
  CASE WHEN p_partkey % 3 = 0 THEN p_name || ' v' || CAST(p_partkey % 400 AS STRING) ELSE p_name END AS c1,
  p_brand AS c2, p_type AS c3, CAST(p_size AS STRING) AS c4,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) AS c5
FROM part
"""

DOCUMENTS_HEADERS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCUMENTS_SQL = """
SELECT doc_id AS row_idx, CAST(doc_id AS STRING) AS c0, text AS c1, lang AS c2, source AS c3,
       CAST(n_chars AS STRING) AS c4
FROM documents
"""

EVENTS_HEADERS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
EVENTS_SQL = """
SELECT event_id AS row_idx, CAST(event_id AS STRING) AS c0,
  CAST(CAST(ts AS DATE) AS STRING) AS c1, CAST(user_id AS STRING) AS c2,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS c3,
  CASE WHEN event_id % 5 < 3 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS c4,
  CASE WHEN event_id % 10 = 1 THEN '同 b' || CAST(event_id AS STRING) ELSE props END AS c5
FROM events
"""

SHEETS = {
    "orders": ("orders", ORDERS_SQL, ORDERS_HEADERS),
    "customers": ("customer", CUSTOMERS_SQL, CUSTOMERS_HEADERS),
    "parts": ("part", PARTS_SQL, PARTS_HEADERS),
    "documents": ("documents", DOCUMENTS_SQL, DOCUMENTS_HEADERS),
    "events": ("events", EVENTS_SQL, EVENTS_HEADERS),
}


def load(spark: SparkSession, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_INGESTED: dict[tuple[str, str, str], DataFrame] = {}


def ingested(spark: SparkSession, sf_dir: str, name: str, derive: Callable[[], DataFrame]) -> DataFrame:
    """Derived input written once per application, as a sheet would be at ingest.

    Only inputs are kept this way; every query computes its result anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _INGESTED:
        _INGESTED[key] = materialize(derive(), keep=True)
    return _INGESTED[key]


def dirty_sheet(spark: SparkSession, sf_dir: str, name: str) -> Sheets:
    table, sql, headers = SHEETS[name]

    def derive() -> DataFrame:
        view = f"tidegrid_{name}"
        spread(load(spark, sf_dir, table)).createOrReplaceTempView(view)
        body = spark.sql(sql.replace(f"FROM {table}", f"FROM {view}"))
        names = [f"c{i}" for i in range(len(headers))]
        return body.selectExpr(f"'{name}' AS sheet_id", "row_idx", *names)

    rows = ingested(spark, sf_dir, name, derive)
    return Sheets(rows, header_table(spark, {name: headers}), len(headers))
