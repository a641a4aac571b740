"""Indicators, structure and issues on small literal sheets."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of  # noqa: F401
from tidegrid import lexicon as lx
from tidegrid.operators import indicators as ind
from tidegrid.operators import structure as st
from tidegrid.operators.issues import detect_issues
from tidegrid.plans.assess import assess
from tidegrid.sheet import union_sheets

ORDER_HEADERS = ["訂單編號", "客戶名稱", "金額", "日期", "狀態"]
ORDER_ROWS = [
    ("ORD-001", "台灣科技公司", "15000", "2024-01-15", "完成"),
    ("ORD-002", "大同企業", "22000", "2024-01-16", "處理中"),
    ("ORD-003", "", "8500", "2024-01-17", "完成"),
    ("ORD-004", "聯發科技", "", "2024/01/18", "取消"),
    ("ORD-005", "鴻海精密", "45000", "2024-01-19", "完成"),
    ("ORD-002", "大同企業", "22000", "2024-01-16", "處理中"),
    ("ORD-006", "台積電", "三萬", "2024-01-20", ""),
    ("ORD-007", "華碩電腦", "12000", "2024-01-21", "完成"),
    ("", "宏碁公司", "9000", "", "處理中"),
    ("ORD-009", "中華電信", "18000", "2024-01-23", "完成"),
]


@pytest.fixture
def order_sheet(make_sheet):
    return make_sheet(ORDER_HEADERS, ORDER_ROWS)


def test_many_literal_sheets_in_one_job(make_sheet, spark):
    """Single-sheet results do not depend on the other sheets of the job."""
    full = [(f"ID-{i}", f"2024-01-{i + 1:02d}", "AB"[i % 2] * 5, str(i * 100)) for i in range(20)]
    merged = spark.createDataFrame([("merged", 1, 1, 1, 2)],
                                   "sheet_id string, start_row int, end_row int, start_col int, end_col int")
    parts = [
        make_sheet(ORDER_HEADERS, ORDER_ROWS, "orders"),
        make_sheet(["identifier", "date", "kind", "amount"], full, "full"),
        make_sheet(["Name"], [("abc",)] * 6, "names"),
        make_sheet(["a1", "b1", "c1"], [("1", "2", "5"), ("", ""), ("", ""), ("3", "4", "6")], "tables"),
        make_sheet(["a1", "b1"], [("1", "2"), ("合計", "3")], "subtotal"),
        make_sheet(["a1", "b1"], [("1", "2"), ("3", "4")], "merged", merged=merged),
        make_sheet(["a1", "b1"], [("Alice", "30")] * 3, "copies"),
        make_sheet(["a1", "b1", "c1", "d1"], [("x", "y")], "short"),
    ]
    got = {r.sheet_id: r for r in assess(union_sheets(parts)).scores.collect()}
    orders = got["orders"]
    assert orders.row_completeness == pytest.approx(90)
    assert orders.column_completeness == pytest.approx(90)
    assert (orders.n_exact_duplicates, orders.n_mismatches) == (1, 1)
    assert got["full"].ai_query_readiness == 100
    assert got["names"].ai_query_readiness == 20
    assert got["tables"].table_structure == 75
    assert got["subtotal"].table_structure == 85
    assert got["merged"].table_structure == 80
    assert got["copies"].duplicate_similar == pytest.approx(33.3)
    assert got["short"].row_completeness == 50
    for r in got.values():
        for k in [*lx.INDICATORS, "total_score"]:
            assert 0 <= r[k] <= 100


def test_orders_issues(order_sheet):
    found = {r.indicator: r for r in detect_issues(assess(order_sheet)).collect()}
    mismatch = found["column_type_mismatch"]
    assert (mismatch.severity, mismatch.affected_rows) == ("High", 1)
    assert mismatch.examples[0].row_number == 8
    assert mismatch.title_en == "Inconsistent Column Types"


def test_weights_are_checked():
    bad = {k: 0.5 for k in lx.INDICATORS}
    with pytest.raises(ValueError):
        ind.check_weights(bad)


def test_weight_resolution(spark):
    good = '{"row_completeness":0.5,"column_completeness":0.5}'
    df = spark.createDataFrame([(1, good), (2, "{}"), (3, None), (4, "oops")], "id int, value string")
    got = {r.id: r.row_completeness for r in ind.resolve_weights(df).collect()}
    assert got == {1: 0.5, 2: 0.25, 3: 0.25, 4: 0.25}


def _blocks(rows):
    """Brute force: scan rows, closing a block at two blanks in a row."""
    out, start, blanks = [], None, 0
    for i, filled in enumerate(rows):
        if filled:
            start = i if start is None else start
            blanks = 0
            continue
        blanks += 1
        if blanks == 2 and start is not None:
            out.append((start, i - 1))
            start = None
    if start is not None:
        out.append((start, len(rows)))
    return out


def test_blocks_match_brute_force(spark, make_sheet):
    import random

    rnd = random.Random(7)
    parts, want = [], {}
    for n in range(12):
        filled = [rnd.random() < 0.45 for _ in range(40)]
        parts.append(make_sheet(["h"], [("x" if f else " ",) for f in filled], f"s{n}"))
        want[f"s{n}"] = _blocks(filled)
    facts = st.filled_counts(union_sheets(parts))
    got = {}
    for r in st.data_blocks(facts).orderBy("sheet_id", "block_idx").collect():
        got.setdefault(r.sheet_id, []).append((r.start_row, r.end_row))
    assert got == want


def test_orphans_after_leading_gap(make_sheet):
    s = make_sheet(["a", "b", "c"], [("", "", ""), ("", "", ""), ("5", "", ""), ("1", "2", "3")])
    gaps = st.gap_summary(st.filled_counts(s))
    assert [r.row_idx for r in st.orphan_rows(st.sparse_rows(s), gaps).collect()] == [2]


def test_near_duplicates_exact_against_brute_force(make_sheet):
    from tidegrid.operators import duplicates as du
    from tidegrid.operators import profile as pf

    names = [f"value {i % 60:02d}" + "x" * (i % 3) + "long " * 80 * (i % 7 == 0) for i in range(120)]
    s = make_sheet(["Name"], [(n,) for n in names])
    values = pf.value_counts(s)
    candidates = pf.column_profile(s, values).select("sheet_id", "col_idx")
    got = {(r.value1, r.value2) for r in du.near_pairs(du.near_values(s, values, candidates)).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    seen = list(dict.fromkeys(names))
    want = {(a, b) for i, a in enumerate(seen) for b in seen[i + 1:]
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    assert got == want


def test_full_near_search_against_brute_force(spark, make_sheet, monkeypatch):
    import random

    from tidegrid.operators import duplicates as du
    from tidegrid.operators import profile as pf

    monkeypatch.setattr(du, "HOT_BLOCK", 3)  # salted blocks
    rnd = random.Random(5)

    def edited(x):
        x = list(x)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(x))
            x[at:at + rnd.randint(0, 1)] = rnd.choice(["", "q", "é", "日", "a"])
        return "".join(x)

    bases = ["".join(rnd.choice("abc") for _ in range(n)) for n in (4, 5, 6, 18, 30, 31, 32, 33, 34, 35, 60, 300)]
    names = [f"Customer#{i:09d}" for i in range(230)] + [edited(b) for b in bases for _ in range(25)]
    names = [n for n in names if n.strip()]
    s = make_sheet([f"Name{i}" for i in range(6)], [("x", "x", "x", "x", "x", n) for n in names])
    flagged = pf.column_profile(s, pf.value_counts(s)).withColumn("is_near_dup_candidate", F.lit(True))
    values = du.all_near_values(s, pf.value_counts(s), flagged)
    found = {(r.col_idx, r.value): (r.n_near, r.first_near) for r in du.near_neighbours(values, du.all_near_pairs(values)).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    seen = [n for n in dict.fromkeys(names) if len(n) > 3]
    near = {n: [] for n in seen}
    for i, a in enumerate(seen):
        for b in seen[i + 1:]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                near[a].append(names.index(b))
                near[b].append(names.index(a))
    assert found == {(5, n): (len(at), min(at)) for n, at in near.items() if at}
    assert any(len(n) > 256 for _, n in found) and len(seen) > du.NEAR_VALUES


def test_strikethrough_and_comments(make_sheet, spark):
    marks = spark.createDataFrame([("s", 1, 0), ("s", 1, 1)], "sheet_id string, row_idx long, col_idx int")
    s = make_sheet(["a1", "b1"], [("1", "2"), ("3", "4")], strikes=marks)
    a = assess(s)
    assert a.scores.first().table_structure == 80  # notes -10, strikethrough -10
    issue = detect_issues(a).filter(F.col("indicator") == "strikethrough_formatting").first()
    assert issue.affected_rows == 1 and issue.examples[0].highlights == [0, 1]
