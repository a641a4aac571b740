"""Plan shape at scale and the registry contract."""

import re

import pytest

import __spark_entry__ as entry
from tidegrid.operators import cleaning as cl
from tidegrid.operators import duplicates as du
from tidegrid.operators import profile as pf
from tidegrid.plans.clean import clean
from tidegrid.session import materialize
from workloads.check import compare
from workloads.dirty import dirty_sheet

SMALL = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().toString()


def test_no_single_partition_exchange_or_cross_join(spark):
    s = dirty_sheet(spark, SMALL, "orders")
    plans = [
        pf.value_counts(s), pf.row_summary(pf.row_facts(s)), cl.subtotal_remove(s)[0].rows,
        cl.dedup(s)[0].rows, cl.date_normalize(s)[0].rows,
    ]
    for df in plans:
        text = physical(df)
        assert "SinglePartition" not in text
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_column_pruning_reaches_the_scan(spark):
    s = dirty_sheet(spark, SMALL, "orders")
    text = physical(s.cells([2]).groupBy("col_idx").count())
    schema = [line for line in text.splitlines() if "ReadSchema" in line][-1]
    assert "c2" in schema and "c1" not in schema.split("ReadSchema")[1]


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["format_types", "clean_dedup", "latest_per_user", "merged_fill"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "events", "customer", "part", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    status, _, detail = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert status == "OK", detail


def test_near_values_meet_without_a_broadcast(spark):
    # Exploded keys are far more than the planner thinks; a broadcast would hold them in the driver.
    rows = [("s", 0, f"Acme {i} Co.", i) for i in range(50)]
    values = materialize(spark.createDataFrame(rows, "sheet_id string, col_idx int, value string, first_row long"))
    text = physical(du.all_near_pairs(values))
    assert re.search(r"SortMergeJoin \[key#\d+L, salt#", text) and not re.search(r"BroadcastHashJoin \[key#\d+L, salt#", text)


def test_facts_of_values_stand_outside_of_branches(spark):
    mask = pf.value_counts(dirty_sheet(spark, SMALL, "orders"))._jdf.queryExecution().analyzed().toString()
    before = mask[:mask.index(" AS mask#")].rsplit("is_long#", 1)[1]
    assert "(coalesce(long_mask#" in before


def test_refined_rows_are_written_once(spark):
    done = clean(dirty_sheet(spark, SMALL, "orders"), ["subtotal_remove", "newline_remove"])
    refined = done.refined()
    assert "bitmap_count" in physical(done.sheets.rows) and "bitmap_count" not in physical(refined.rows)
    assert done.stored is done.stored
    assert refined.rows.exceptAll(done.sheets.rows).isEmpty() and refined.rows.count() == done.sheets.rows.count()
