from tidegrid.operators import fingerprint as fp


def test_descending_names_the_changed_stretches(make_sheet):
    rows = [(str(i), f"v{i}") for i in range(200)]
    tree = lambda rows, names=("a", "b"): fp.hash_tree(fp.row_digests(make_sheet(list(names), rows)), 8, 3)
    found = lambda x, y: {(r.first_row, r.last_row) for r in fp.changed_stretches(x, y, 8, 3).collect()}
    base = tree(rows)
    roots = base.groupBy("level").count().orderBy("level").collect()
    assert [r["count"] for r in roots] == [26, 9, 3, 1]
    assert found(base, tree(rows)) == set()
    edited = list(rows)
    edited[6], edited[100] = ("6", "x"), ("100", "")
    assert found(base, tree(edited)) == {(-1, 6), (95, 102)}
    assert found(base, tree(rows, ("a", "c"))) == {(-1, 6)}
    assert found(base, tree(rows[:60])) == {(k * 8 - 1, k * 8 + 6) for k in range(7, 26)}
    assert found(tree(rows[:5]), base) == {(k * 8 - 1, k * 8 + 6) for k in range(26)}
