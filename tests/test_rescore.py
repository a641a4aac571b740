"""Signed deltas against a full assessment of the changed sheet."""

import random

from tidegrid.operators import profile as pf
from tidegrid.plans.assess import assess
from tidegrid.plans.rescore import rescore, score_state

PATCHES = "sheet_id string, row_idx long, col_idx int, value string"
REMOVED = "sheet_id string, row_idx long"


def rows_of(df, *drop):
    names = sorted(c for c in df.columns if c not in drop)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def changed(rows, patches, removed):
    rows = [list(r) for r in rows]
    for i, j, v in patches:
        rows[i][j] = v
    return [r for i, r in enumerate(rows) if i not in removed]


def assert_follows(spark, make_sheet, rows, patches, removed):
    names = ["a", "b", "date"]
    state = rescore(
        score_state(make_sheet(names, rows)),
        spark.createDataFrame([("s", *p) for p in patches], PATCHES),
        spark.createDataFrame([("s", r) for r in removed for _ in range(2)], REMOVED))
    want_sheet = make_sheet(names, changed(rows, patches, removed))
    want = assess(want_sheet)
    got = state.assessment
    assert rows_of(got.values) == rows_of(want.values)
    assert rows_of(got.sparse) == rows_of(want.sparse)
    assert rows_of(got.columns) == rows_of(want.columns)
    assert rows_of(got.scores) == rows_of(want.scores)
    assert rows_of(state.groups.drop("lo", "hi")) == rows_of(pf.row_groups(pf.row_facts(want_sheet)).drop("lo", "hi"))
    assert rows_of(got.sheets.rows) == rows_of(want_sheet.rows)


def test_random_changes(spark, make_sheet):
    pick = random.Random(1)
    words = ["x", "y", None, "", "Total", "12", "2024-01-02", "long " * 80, "é(備註)"]
    rows = [[pick.choice(words) for _ in range(3)] for _ in range(150)]
    for i in (0, 1, 60, 61, 62, 148, 149):
        rows[i] = [None, None, None]
    cells = pick.sample([(i, j) for i in range(150) for j in range(3)], 30)
    patches = [(i, j, pick.choice(words)) for i, j in cells]
    assert_follows(spark, make_sheet, rows, patches, set(pick.sample(range(150), 12)) | {0, 149})


def test_edits_alone_and_nothing(spark, make_sheet):
    rows = [["v", str(i % 7), "2024-01-0%d" % (i % 9 + 1)] for i in range(120)]
    assert_follows(spark, make_sheet, rows, [(0, 0, "w"), (0, 1, None), (119, 2, "v")], set())


def test_all_rows_removed(spark, make_sheet):
    rows = [["v", "1", None], [None, None, None], ["v", "1", None]]
    state = rescore(
        score_state(make_sheet(["a", "b", "c"], rows)),
        spark.createDataFrame([("s", 0, 0, "patched")], PATCHES),
        spark.createDataFrame([("s", i) for i in range(3)], REMOVED))
    assert state.assessment.values.count() == 0 and state.groups.count() == 0
    assert state.assessment.sparse.count() == 0


def test_changes_follow_each_other(spark, make_sheet):
    rows = [["v%d" % (i % 5), str(i), None] for i in range(20)]
    first = rescore(score_state(make_sheet(["a", "b", "c"], rows)),
                    spark.createDataFrame([("s", 3, 2, "n")], PATCHES), spark.createDataFrame([("s", 0)], REMOVED))
    second = rescore(first, spark.createDataFrame([("s", 2, 2, "m")], PATCHES), spark.createDataFrame([("s", 0)], REMOVED))
    want = make_sheet(["a", "b", "c"], changed(changed(rows, [(3, 2, "n")], {0}), [(2, 2, "m")], {0}))
    assert rows_of(second.assessment.values) == rows_of(pf.value_counts(want))
