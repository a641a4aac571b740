import hashlib
import math
import random

import numpy as np
import pytest

from tidegrid.llm.vector_codes import nearest, sequency_order, vector_codes, walsh, with_label_errors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, `__x` int, error double"


def plain(rows, parts, entries, rounds=2):
    """Codes, errors and final codebooks with Python integers; rows: (vec_id, list of floats) of one length."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = lambda v: [[math.floor(256 * x) for x in v[p * width:(p + 1) * width]] for p in range(parts)]
    books = [[cut(v)[p] for _, v in order[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    find = lambda part, book: min((gap(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in rows:
                groups.setdefault(find(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e
                        for k, e in enumerate(books[p])]
    out = []
    for i, v in rows:
        found = [find(cut(v)[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_sequency_order_counts_sign_changes():
    for n in (1, 2, 4, 8, 16):
        waves = walsh(np.eye(n, dtype=np.int64)).T
        assert [int((w[1:] != w[:-1]).sum()) for w in waves] == list(range(n))
        assert sorted(sequency_order(n)) == list(range(n))


@pytest.mark.parametrize("width", [1, 3, 4, 7])
def test_nearest_is_exact_with_ties_to_the_lower_index(width):
    rnd = np.random.default_rng(width)
    points, entries = rnd.integers(-4, 5, (500, width)), rnd.integers(-4, 5, (40, width))
    index, scaled = nearest(walsh(points), walsh(entries))
    gaps = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (index == gaps.argmin(1)).all()
    assert (scaled == gaps.min(1) * (1 << max(width - 1, 0).bit_length())).all()


@pytest.mark.parametrize("dims,parts,entries", [(12, 4, 5), (8, 8, 3), (6, 2, 64)])
def test_against_brute_force(spark, dims, parts, entries):
    rnd = random.Random(dims)
    rows = [(i, [float(np.float32(rnd.gauss(0, 0.3))) for _ in range(dims)]) for i in range(60)]
    rows += [(i, rows[0][1]) for i in range(100, 130)] + [(7, rows[9][1]), (7, rows[7][1]), (None, rows[3][1])]
    table = [(i, v, None if k % 5 == 0 else k % 3, "x", 1, 0.5) for k, (i, v) in enumerate(rows)]
    table += [(900, None, 1, None, None, None), (901, [float("nan")] * dims, 1, None, None, None),
              (902, [float("inf")] + [0.0] * (dims - 1), 1, None, None, None),
              (903, [None] + [0.0] * (dims - 1), 1, None, None, None)]
    codes = vector_codes(spark.createDataFrame(table, SCHEMA).repartition(5), parts=parts, entries=entries)
    got = with_label_errors(codes).collect()
    want, digest = plain(rows, parts, entries)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = {}
    for (_, _, label, *_), (_, _, e) in zip(table, want):
        sums[label] = sums.get(label, 0) + e
    assert {(r.label, r.label_error) for r in got} == set(sums.items())


def test_other_lengths_large_components_and_empty_tables(spark):
    rows = [(1, [0.5] * 4, 1), (2, [0.25] * 4, 1), (3, [1.0] * 3, None), (4, [], 2), (5, [1e30] * 4, 2), (6, [0.5] * 4, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in with_label_errors(vector_codes(df, parts=2, entries=4)).collect()}
    assert {i for i, r in got.items() if r.code is None and r.error is None} == {3, 4, 5}
    assert got[1].code == got[6].code == "0000" and got[2].code == "0101" and got[2].error == 0
    assert got[3].label_error is None and got[4].label_error == 0
    for nothing in (df.limit(0), df.filter("vec_id in (4, 5)")):
        codes = vector_codes(nothing, parts=2)
        assert codes.codebooks == [] and all(r.code is None for r in with_label_errors(codes).collect())
    with pytest.raises(ValueError):
        vector_codes(df, entries=257)
