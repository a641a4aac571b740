import random
import re

from pyspark.sql import functions as F

from tidegrid.functions import cells as fx
from tidegrid.sources import grid as gr


def plain_fill(cells, ranges):
    """Cell by cell: the covering range with a value and the smallest number."""
    out = {}
    for (sheet, r, c), v in cells.items():
        fill = v
        if not v:
            for _, s, r0, c0, r1, c1 in sorted(ranges):
                if s == sheet and r0 <= r + 1 <= r1 and c0 <= c + 1 <= c1 and cells.get((s, r0 - 1, c0 - 1)):
                    fill = cells[s, r0 - 1, c0 - 1]
                    break
        out[sheet, r, c] = fill
    return out


def test_ranges_of_all_heights(spark, monkeypatch):
    monkeypatch.setattr(gr, "LARGE_ROWS", 32)
    monkeypatch.setattr(gr, "SMALL_ROWS", 4)
    rnd = random.Random(2)
    cells = {(s, r, c): rnd.choice([None, "", f"{s}{r}.{c}"]) for s in "ab" for r in range(150) for c in range(3)}
    ranges = []
    for n in range(80):
        r0, c0 = rnd.randrange(1, 150), rnd.randrange(1, 4)
        ranges.append((n, rnd.choice("ab"), r0, c0, r0 + rnd.choice([0, 1, 3, 7, 31, 40, 70, 500]), rnd.randrange(c0, 4)))
    rnd.shuffle(ranges)
    grid = spark.createDataFrame([(s, r, *(cells[s, r, c] for c in range(3))) for s in "ab" for r in range(150)],
                                 "sheet_id string, row_no int, c0 string, c1 string, c2 string")
    merged = spark.createDataFrame(ranges, "range_no int, sheet_id string, start_row int, start_col int, end_row int, end_col int")
    got = {(r.sheet_id, r.row_no, c): r[f"c{c}"] for r in gr.fill_merged(grid, merged).collect() for c in range(3)}
    assert got == plain_fill(cells, ranges)


def test_a_tall_range_makes_few_bucket_numbers(spark):
    df = spark.createDataFrame([(5, 10_000_004), (0, 65_535), (0, 65_534), (70_000, 70_001), (3, 3)], "a long, b long")
    large, small = gr._buckets(df["a"], df["b"])
    got = df.select("a", "b", large.alias("large"), small.alias("small")).collect()
    assert len(got[0].large) == 151 and len(got[0].small) <= 512
    assert got[1].large == [0] and got[1].small == [] and got[2].large == [] and len(got[2].small) == 256
    for r in got:
        covered = [(x * 65_536, (x + 1) * 65_536) for x in r.large] + [(x * 256, (x + 1) * 256) for x in r.small]
        covered = sorted(covered)
        assert covered[0][0] <= r.a and covered[-1][1] > r.b
        assert all(x[1] == y[0] for x, y in zip(covered, covered[1:]))


def test_header_scores_trim_a_cell_once(spark):
    rnd = random.Random(5)
    words = ["Name", " name", "Amount", "1,234", " 1e3 ", "1e400", "NaN", "12d", "2024/01/05", "113.1.5", "", None, "　", "x\ny", "y" * 51, "a" * 25, ","]
    data = [(f"s{n % 3}", n // 3, *(rnd.choice(words) for _ in range(4))) for n in range(300)]
    grid = spark.createDataFrame(data, "sheet_id string, row_no int, c0 string, c1 string, c2 string, c3 string")
    scores = gr.header_scores(grid)
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1
    numbers = {r.v for r in spark.createDataFrame([(w,) for w in words if w], "v string").filter(fx.is_num(F.col("v"))).collect()}
    assert numbers == {"1,234", " 1e3 ", "NaN"}

    def plain(cells):
        values = [(c or "").strip(" 　") for c in cells]
        raw, values = [c or "" for c, v in zip(cells, values) if v], [v for v in values if v]
        if not values:
            return -1
        mean = sum(map(len, values)) / len(values)
        typed = any(r in numbers or re.fullmatch(r"\d{4}/\d\d/\d\d|\d{3}\.\d\.\d", v) for r, v in zip(raw, values))
        return ((30 if len(values) >= 3.2 else 15 if len(values) >= 2 else 0) + (0 if typed else 20)
                + (20 if len({v.lower() for v in values}) == len(values) else 0) + (15 if 2 <= mean <= 20 else 0)
                + (0 if any(len(r) > 50 or "\n" in r for r in raw) else 10))

    got = {(r.sheet_id, r.row_no): r.score for r in scores.collect()}
    assert got == {(s, n): plain(cells) for s, n, *cells in data if n < 10}
