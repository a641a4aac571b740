"""Cleaning rules, batch plan, edits and sinks."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tidegrid.operators import cleaning as cl
from tidegrid.operators import edits as ed
from tidegrid.operators import fingerprint as fp
from tidegrid.operators import positions as po
from tidegrid.operators import reports as rp
from tidegrid.plans.clean import clean
from tidegrid.sources import csv as csvio


def touched(log):
    return sorted(r.row_idx for r in log.collect())


def test_dedup_keeps_first(make_sheet):
    s = make_sheet(["a", "b"], [("a", "1"), ("b", "2"), ("a", "1"), ("c", "3"), ("b", "2")])
    out, log = cl.dedup(s)
    assert rows_of(out) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert touched(log) == [2, 4]
    assert rows_of(cl.dedup(out)[0]) == rows_of(out)


def test_name_normalize(make_sheet):
    names = ["台灣科技股份有限公司", "台灣科技有限公司", "台灣科技", "其他企業"]
    out, log = cl.name_normalize(make_sheet(["n"], [(n,) for n in names]))
    assert rows_of(out) == [(names[0],)] * 3 + [("其他企業",)]
    assert touched(log) == [1, 2]
    english = make_sheet(["n"], [("Acme",), ("Acme Co.",), ("Acme Corp.",), ("Acme Corp.",)])
    assert rows_of(cl.name_normalize(english)[0]) == [("Acme Corp.",)] * 4


def test_date_normalize(make_sheet):
    s = make_sheet(["d", "x"], [("2023/3/9", "1"), ("113.1.5", "2"), ("2024/01/15", "3"), ("n/a", "4")])
    out, log = cl.date_normalize(s)
    assert [r[0] for r in rows_of(out)] == ["2023/03/09", "2024/01/05", "2024/01/15", "n/a"]
    assert touched(log) == [0, 1]


def test_subtotal_and_whole_word(make_sheet):
    s = make_sheet(["a"], [("x",), ("小計",), ("TOTAL",), ("Totally",), ("Subtotal",)])
    assert rows_of(cl.subtotal_remove(s)[0]) == [("x",)]
    assert rows_of(cl.subtotal_remove(s, whole_word=True)[0]) == [("x",), ("Totally",)]


def test_bracket_notes_beyond_unrolled_passes(make_sheet):
    many = "a" + "".join(f"(中{i})" for i in range(7)) + "b（全）(x)"
    out, _ = cl.bracket_note_remove(make_sheet(["a", "b"], [(many, " y "), ("(中文)", "(v2)")]))
    assert rows_of(out) == [("ab(x)", "y"), ("", "(v2)")]


def test_blocks_columns_and_row_ops(make_sheet, spark):
    s = make_sheet(["a", "b"], [("1", "")] * 3 + [("", "")] * 2 + [("2", "z")] * 4)
    assert [r[0] for r in rows_of(cl.multi_table_keep(s)[0])] == ["2"] * 4
    assert [r[0] for r in rows_of(cl.multi_table_keep(s, 0)[0])] == ["1"] * 3
    assert [r[0] for r in rows_of(cl.multi_table_keep(s, 9)[0])] == ["2"] * 4
    wide = make_sheet(["a", "b", "c"], [("1", "", "3")] * 10)
    out, _ = cl.empty_col_remove(wide)
    assert out.width == 2 and rows_of(out) == [("1", "3")] * 10
    assert [r.name for r in out.headers.orderBy("col_idx").collect()] == ["a", "c"]
    ops = spark.createDataFrame([("s", 0, "fill_na"), ("s", 1, "delete"), ("s", 99, "delete")],
                                "sheet_id string, row_idx long, action string")
    done = clean(make_sheet(["a", "b"], [("v", " "), ("gone", "x"), ("w", "y")]), [], row_ops=ops)
    assert rows_of(done.sheets) == [("v", "N/A"), ("w", "y")]


def test_pipeline_partition_of_rows(make_sheet):
    s = make_sheet(["a", "b"], [("x", "1"), ("合計", "2"), ("", ""), ("x", "1"), ("y\nz", "3")])
    done = clean(s, ["subtotal_remove", "empty_row_remove", "dedup", "newline_remove"])
    assert rows_of(done.sheets) == [("x", "1"), ("y z", "3")]
    entries = {r.operation_type: r.n_rows for r in done.entries().collect()}
    assert entries == {"subtotal_remove": 1, "empty_row_remove": 1, "dedup": 1, "newline_remove": 1}
    lines = rp.log_lines(done.log, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()
    assert "[2024-01-01 00:00:00] 移除小計列：第 1 列 — 移除 1 筆小計/合計列" in {r.line for r in lines}
    with pytest.raises(ValueError):
        clean(s, ["unknown_rule"])


def test_log_lines_split_long_entries(make_sheet):
    s = make_sheet(["a"], [("total",)] * 25)
    log = cl.subtotal_remove(s)[1].withColumn("seq", F.lit(0))
    lines = rp.log_lines(log, F.current_timestamp(), rows_per_line=10).collect()
    assert sorted(r.part for r in lines) == [0, 1, 2]
    assert sorted(r.line.count(", ") + 1 for r in lines) == [5, 10, 10]


def test_log_line_of_distant_rows_is_one(make_sheet):
    s = make_sheet(["a"], [("total",)] + [("x",)] * 30 + [("total",)])
    log = cl.subtotal_remove(s)[1].withColumn("seq", F.lit(0))
    lines = rp.log_lines(log, F.current_timestamp(), rows_per_line=10).collect()
    assert len(lines) == 1 and "第 0, 31 列" in lines[0].line


def test_edits(make_sheet, spark):
    s = make_sheet(["a", "b"], [("A(備註甲)", "1"), ("x", "2"), ("y", "3")])
    schema = "edit_no long, sheet_id string, row_idx long, col_idx int, action string, value string"
    edits = spark.createDataFrame([
        (1, "s", 1, 1, "replace", "first"), (2, "s", 1, 1, "replace", "second"),
        (3, "s", 0, 0, "remark_split", ""), (4, "s", 0, 1, "header_rename", "B"),
        (5, "s", 2, 0, "delete_row", ""), (6, "s", 50, 0, "replace", "v"), (7, "s", 0, 0, "keep", ""),
        (8, "s", 1, 0, "remark_split", ""),
    ], schema)
    done = ed.apply_edits(s, edits)
    assert rows_of(done.sheets) == [("A", "1", "備註甲"), ("x", "second", None)]
    assert [r.name for r in done.sheets.headers.orderBy("col_idx").collect()] == ["a", "B", "備註"]
    assert {r.edit_no for r in done.warnings.collect()} == {6, 8}
    bad = spark.createDataFrame([(1, "s", 0, 0, "replace", " ")], schema)
    with pytest.raises(ValueError):
        ed.apply_edits(s, bad)


def test_reindex_is_dense_across_buckets(spark):
    rows = spark.range(0, 5000).filter("id % 7 <> 0 AND NOT (id BETWEEN 900 AND 2100)").select(
        F.lit("s").alias("sheet_id"), F.col("id").alias("row_idx"), F.col("id").cast("string").alias("c0"))
    got = [(r.row_idx, int(r.c0)) for r in po.reindex(rows, 100).orderBy("row_idx").collect()]
    keep = [i for i in range(5000) if i % 7 and not 900 <= i <= 2100]
    assert got == list(enumerate(keep))


def test_csv_loader(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿Name,Age,City\nAlice,30,Taipei\nBob,,"Kao\nhsiung"\n   \nx,1,2,3\n', encoding="utf-8")
    s = csvio.read_csv_sheet(spark, str(path), "s", max_width=8)
    assert [r.name for r in s.headers.orderBy("col_idx").collect()] == ["Name", "Age", "City", ""]
    assert rows_of(s)[:2] == [("Alice", "30", "Taipei", ""), ("Bob", "", "Kao\nhsiung", "")]
    meta = csvio.csv_metadata(spark, str(path)).first()
    assert (meta.row_count, meta.col_count, meta.too_many_rows) == (5, 4, False)


def test_csv_and_parquet_round_trip(make_sheet, spark, tmp_path):
    s = make_sheet(["h1", "", "h1"], [("a,b", 'q"x', ""), ("line\nbreak", "　", "z")])
    csvio.write_refined_csv(s, str(tmp_path / "csv"))
    back = csvio.read_csv_parts(spark, str(tmp_path / "csv"), "s")
    assert rows_of(back) == rows_of(s)
    csvio.write_sheets(s, str(tmp_path / "native"))
    assert rows_of(csvio.read_sheets(spark, str(tmp_path / "native"))) == rows_of(s)


def test_upload_validation(spark):
    files = spark.createDataFrame([
        ("a.csv", 10, 5, ["Sheet1"], None), ("b.pdf", 10, 5, [], None),
        ("c.xlsx", 99 * 1024 * 1024, 200_000, ["A", "B"], "C"),
    ], "path string, length long, row_count long, sheets array<string>, selected string")
    got = {(r.path, r.violation) for r in csvio.validate_files(files).collect()}
    assert got == {("b.pdf", "unsupported_format"), ("c.xlsx", "file_too_large"),
                   ("c.xlsx", "too_many_rows"), ("c.xlsx", "sheet_not_found")}
    assert csvio.select_sheet(files).first().selected == "Sheet1"


def test_fingerprint_ignores_partitioning(make_sheet):
    s = make_sheet(["a"], [(str(i),) for i in range(50)])
    one = fp.dataset_fingerprint(fp.row_digests(s))
    two = fp.dataset_fingerprint(fp.row_digests(s.with_rows(s.rows.repartition(7))))
    assert one.first().fingerprint == two.first().fingerprint
    assert fp.verify(one, two).first().is_valid
    other = make_sheet(["b"], [(str(i),) for i in range(50)])
    assert fp.dataset_fingerprint(fp.row_digests(other)).first().fingerprint != one.first().fingerprint


def test_row_numbers_follow_file_order(spark, tmp_path):
    folder = str(tmp_path / "many")
    spark.range(0, 1000, 1, 7).select(F.col("id"), F.col("id").cast("string").alias("t")).write.parquet(folder)
    numbered = po.number_parquet_rows(spark.read.parquet(folder))
    assert [r.id for r in numbered.orderBy("row_idx").collect()] == list(range(1000))
    assert numbered.agg(F.min("row_idx"), F.max("row_idx"), F.count_distinct("row_idx")).first()[0:3] == (0, 999, 1000)
    lines = str(tmp_path / "csv")
    spark.range(0, 500, 1, 5).write.csv(lines)
    text = po.number_rows(spark.read.schema("id long").csv(lines))
    assert [(r.row_idx, r.id) for r in text.orderBy("row_idx").collect()] == [(i, i) for i in range(500)]


def test_user_text_with_a_count_mark_is_logged_as_it_is(make_sheet, spark):
    s = make_sheet(["a"], [("old",)])
    schema = "edit_no long, sheet_id string, row_idx long, col_idx int, action string, value string"
    done = ed.apply_edits(s, spark.createDataFrame([(1, "s", 0, 0, "replace", "50%d off")], schema))
    assert "50%d off" in cl.audit_entries(done.log).first().details


def test_second_split_of_a_cell_works_on_what_is_left(make_sheet, spark):
    s = make_sheet(["a"], [("PI(中文一)(中文二)",)])
    schema = "edit_no long, sheet_id string, row_idx long, col_idx int, action string, value string"
    edits = spark.createDataFrame([(i, "s", 0, 0, "remark_split", "") for i in (1, 2)], schema)
    assert rows_of(ed.apply_edits(s, edits).sheets) == [("PI", "中文一")]


def test_many_mixed_notes(make_sheet):
    s = make_sheet(["a"], [("x(備)(註)（一）(二)y(三)（四）(五)",), ("（甲(乙）丙)",), ("(a)(中)",), ("plain",)])
    done, log = cl.bracket_note_remove(s)
    assert rows_of(done) == [("xy",), ("（甲",), ("(a)(中)",), ("plain",)]
    assert log.count() == 2


def test_wide_and_empty_csv(spark, tmp_path):
    wide = tmp_path / "wide.csv"
    wide.write_text(",".join(f"h{i}" for i in range(2000)) + "\n" + ",".join(['"a,""b\nc"'] * 2000) + "\n")
    s = csvio.read_csv_sheet(spark, str(wide), "w")
    assert s.width == 2000 and set(rows_of(s)[0]) == {'a,"b\nc'}
    assert csvio.csv_metadata(spark, str(wide)).first()[1:3] == (2, 2000)
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    from tidegrid.plans.assess import assess

    row = assess(csvio.read_csv_sheet(spark, str(empty), "e")).result().first()
    assert (row.sheet_id, row.total_rows, row.row_completeness, row.duplicate_similar) == ("e", 0, 0.0, 100.0)
    head = tmp_path / "head.csv"
    head.write_text("a,b\n")
    row = assess(csvio.read_csv_sheet(spark, str(head), "h")).result().first()
    assert row.total_rows == 0 and len(row.column_details) == 2


def test_blank_grid_is_a_sheet_without_columns(spark):
    from tidegrid.plans.assess import assess
    from tidegrid.sources.grid import sheets_from_grid

    grid = spark.createDataFrame([("blank", 0, None, None), ("g", 0, "h", "i"), ("g", 1, "1", "2")],
                                 "sheet_id string, row_no int, c0 string, c1 string")
    rows = {r.sheet_id: r for r in assess(sheets_from_grid(grid)).scores.collect()}
    assert set(rows) == {"blank", "g"} and rows["blank"].n_cols == 0 and rows["g"].n_rows == 1


def test_bitmap_ranks_and_runs_against_plain_lists(spark):
    import random

    rnd = random.Random(6)
    held = sorted(rnd.sample(range(120_000), 70_000))
    df = spark.createDataFrame([("s", i) for i in held] + [("t", 5), ("t", 40_000)], "sheet_id string, row_idx long").repartition(5)
    got = {(r.sheet_id, r.row_idx) for r in po.reindex(df).collect()}
    assert got == {("s", i) for i in range(70_000)} | {("t", 0), ("t", 1)}
    ranks = po.alive_ranks(df)
    some = spark.createDataFrame([("s", i) for i in held[::5000]] + [("s", None)], "sheet_id string, row_idx long")
    assert sorted((r.row_idx for r in po.ranked(some, ranks).collect()), key=str) == sorted([*range(0, 70_000, 5000), None], key=str)
    positions = sorted({*range(0, 30), *range(35, 40), 45, 49, 50, *range(60, 70), *range(95, 131), 200})
    df = spark.createDataFrame([("k", None, i) for i in positions] + [("k", 1, 3), ("k", 1, None)], "a string, item int, row_idx long")
    got = {(r.item, r.first, r.last) for r in po.runs(df, ["a", "item"], bucket_rows=10).collect()}
    assert got == {(None, 0, 29), (None, 35, 39), (None, 45, 45), (None, 49, 50), (None, 60, 69), (None, 95, 130), (None, 200, 200), (1, 3, 3)}


def test_rules_number_rows_once_and_log_the_rows_they_find(spark, make_sheet, monkeypatch):
    from tidegrid.plans import clean as plan

    calls = []
    real = plan.reindex
    monkeypatch.setattr(plan, "reindex", lambda rows: (calls.append(1), real(rows))[1])
    s = make_sheet(["a", "b"], [("x", "1"), ("小計", "2"), ("", " "), ("x", "1"), ("y\nz", "3"), ("合計", "9"), ("x", "1"), ("w", "4")])
    done = plan.clean(s, ["subtotal_remove", "empty_row_remove", "dedup", "newline_remove"])
    assert rows_of(done.sheets) == [("x", "1"), ("y z", "3"), ("w", "4")]
    assert [r.row_idx for r in done.sheets.rows.orderBy("row_idx").collect()] == [0, 1, 2] and len(calls) == 1
    found = {}
    for r in done.log.collect():
        found.setdefault(r.operation_type, set()).add(r.row_idx)
    assert found == {"subtotal_remove": {1, 5}, "empty_row_remove": {1}, "dedup": {1, 3}, "newline_remove": {1}}


def test_a_session_reports_rows_scores_time_and_operator(make_sheet):
    from tidegrid.plans.assess import assess
    from tidegrid.plans.session import cleaning_session

    s = make_sheet(["a", "b"], [("x", "1"), ("小計", "2"), ("小計", "3"), ("y", "4\n5")])
    done = cleaning_session(s, ["subtotal_remove", "newline_remove"], "someone", "2024-05-06 07:08:09")
    row = done.sessions.first()
    assert (row.rows_before, row.rows_after, row.rules_applied) == (4, 2, ["subtotal_remove", "newline_remove"])
    assert row.score_before == assess(s).scores.first().total_score
    assert row.score_after == assess(done.cleaned.sheets, with_issues=False).scores.first().total_score
    got = {(r.operation_type, r.first, r.last, r.n_rows, r.operator_id, str(r.timestamp)) for r in done.entries.collect()}
    assert got == {("subtotal_remove", 1, 2, 2, "someone", "2024-05-06 07:08:09"), ("newline_remove", 1, 1, 1, "someone", "2024-05-06 07:08:09")}


def test_a_sheet_that_loses_all_columns_keeps_its_rows(make_sheet):
    s = make_sheet(["a", "b"], [("", " "), (None, "")])
    done, log = cl.empty_col_remove(s)
    assert done.rows.count() == 2 and log.count() == 1
