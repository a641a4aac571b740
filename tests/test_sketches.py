"""Stored sketches against exact distinct counts."""

from tidegrid.operators.sketches import ERROR_BOUND, SketchStore


def test_parts_merge_and_replace_themselves(spark, make_sheet, tmp_path):
    store = SketchStore(spark, str(tmp_path / "sketches"))
    parts = [[(str(i), str(i % 3)) for i in range(a, a + 3000)] for a in (0, 2000, 4000)]
    for no, rows in enumerate(parts):
        store.add(f"p{no}", make_sheet(["id", "kind"], rows))
    store.add("p2", make_sheet(["id", "kind"], parts[2]))
    got = {r.col_idx: r for r in store.distinct_counts().collect()}
    assert got[0].n_nonempty == got[1].n_nonempty == 9000
    assert abs(got[0].n_distinct - 7000) <= 7000 * ERROR_BOUND
    assert got[1].n_distinct == 3


def test_blank_columns_and_mixed_sizes(spark, make_sheet, tmp_path):
    store = SketchStore(spark, str(tmp_path / "sketches"))
    store.add("a", make_sheet(["id", "none"], [("x", None), ("y", " ")]))
    store.add("b", make_sheet(["id", "none"], [("x", ""), ("z", None)]), lg_k=10)
    assert [(r.col_idx, r.n_nonempty, r.n_distinct) for r in store.distinct_counts().collect()] == [(0, 4, 3)]
