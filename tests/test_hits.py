"""Masks of row problems against a row-by-row version."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import hits as hx
from tidegrid.operators import issues as iss
from tidegrid.plans.assess import assess
from tidegrid.sheet import union_sheets


def _bits(n):
    return [hx.Bit(f"k{i}" if i % 3 else "remark", F.col("on")[i], i if i % 3 == 0 else -1) for i in range(n)]


@pytest.mark.parametrize("n_bits", [5, 130])
def test_counts_and_first_rows_match_brute_force(spark, n_bits):
    """More bits than one mask holds, buckets of four rows, and a bit on nearly every row."""
    rnd = random.Random(3)
    share = [rnd.choice([0.0, 0.02, 0.3, 0.95]) for _ in range(n_bits)]
    rows = [(s, i, [rnd.random() < p for p in share]) for s in ("a", "b") for i in range(60)]
    bits = _bits(n_bits)
    table = spark.createDataFrame(rows, "sheet_id string, row_idx bigint, on array<boolean>")
    masks = [F.lit(0).cast("long")] * ((n_bits - 1) // hx.MASK_BITS + 1)
    for n, bit in enumerate(bits):
        word = F.when(bit.hit, F.lit(1 << n % hx.MASK_BITS).cast("long")).otherwise(F.lit(0).cast("long"))
        masks[n // hx.MASK_BITS] = masks[n // hx.MASK_BITS] + word
    hits = table.select("sheet_id", "row_idx", *[m.alias(f"mask{i}") for i, m in enumerate(masks)])
    counts = hx.hit_counts(hits, bits, 4)

    got = {r.sheet_id: r.asDict() for r in hx.affected_rows(counts, bits).collect()}
    for s in ("a", "b"):
        for n, bit in enumerate(bits):
            if bit.item < 0:
                assert got[s][f"rows_{bit.kind}"] == sum(on[n] for sheet, _, on in rows if sheet == s)

    want = set()
    for s in ("a", "b"):
        per_kind = {}
        for n, bit in enumerate(bits):
            at = [(bit.item if bit.kind == "remark" else -1, i) for sheet, i, on in rows if sheet == s and on[n]]
            per_kind.setdefault(bit.kind, []).extend(at)
        want |= {(s, kind, *place) for kind, places in per_kind.items() for place in sorted(places)[:3]}
    found = {(r.sheet_id, r.kind, r.ord, r.row_idx) for r in hx.first_hits(hits, counts, bits, 3, 4).collect()}
    assert found == want


def test_first_rows_come_from_few_buckets(spark):
    """A bit on every row: the rows looked into are those of the first buckets only."""
    hits = spark.range(100_000).select(F.lit("s").alias("sheet_id"), F.col("id").alias("row_idx"), F.lit(1).cast("long").alias("mask0"))
    bits = [hx.Bit("k", F.lit(True))]
    counts = hx.hit_counts(hits, bits, 10)
    assert counts.count() == 10_000
    assert [r.row_idx for r in hx.first_hits(hits, counts, bits, 4, 10).orderBy("row_idx").collect()] == [0, 1, 2, 3]


def _plain(rows, headers):
    """Row by row: 1-based sheet rows (header is row 1) with a blank cell, a reference and a number that is none."""
    import re

    blank = [i for i, r in enumerate(rows) if any(not (c or "").strip() for c in r)]
    same = [i for i, r in enumerate(rows) if any(re.fullmatch("同[A-Z]+[0-9]+", (c or "").strip()) for c in r)]
    amount = [i for i, r in enumerate(rows) if (r[1] or "").strip() and not re.fullmatch("[0-9]+", r[1].strip())]
    return {"row_completeness": blank, "cell_reference_placeholder": same, "column_type_mismatch": amount}


def test_issue_rows_match_a_row_by_row_version(make_sheet):
    """Random sheets: affected rows and the first rows shown, with null, blank and very long cells."""
    rnd = random.Random(11)
    headers, parts, texts = ["Name", "Amount", "Ref"], [], {}
    for n in range(3):
        rows = []
        for _ in range(90):
            rows.append((
                rnd.choice(["acme", None, "  ", "x" * 3000, "beta"]),
                rnd.choice(["12", "7", "100", "31", "8", "55", "n/a"]),
                rnd.choice(["同AH2", "ok", "", "fine", "one\ntwo"]),
            ))
        texts[f"s{n}"] = rows
        parts.append(make_sheet(headers, rows, f"s{n}"))
    found = {}
    for r in iss.detect_issues(assess(union_sheets(parts)), merge=False).collect():
        found[r.sheet_id, r.indicator] = r
    for s, rows in texts.items():
        for indicator, at in _plain(rows, headers).items():
            issue = found.get((s, indicator))
            assert issue is not None, (s, indicator)
            assert issue.affected_rows == len(at), (s, indicator)
            limit = 8 if indicator == "column_type_mismatch" else 5
            assert [e.row_number for e in issue.examples] == [i + 2 for i in at[:limit]], (s, indicator)


def test_sheet_without_rows_has_counts_of_zero(make_sheet):
    """A sheet of headers only beside one with problems: its issues count no rows and show none."""
    s = union_sheets([make_sheet(["a", "b"], [("1", ""), ("", "2"), ("同A1", "x")], "some"), make_sheet(["a", "b"], [], "none")])
    for r in iss.detect_issues(assess(s), merge=False).filter("sheet_id = 'none'").collect():
        assert r.affected_rows is not None and (r.examples == [] or r.indicator == "ai_query_readiness")
