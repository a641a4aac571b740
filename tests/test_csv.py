import random

import pytest

from tidegrid.sources import csv as csvio
from tidegrid.sources.csv import csv_metadata, csv_records, read_csv_sheet


def plain_records(text):
    """A sequential reader, character by character: lazy quotes, empty lines are no records."""
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    if lines and lines[-1] == "":
        lines.pop()
    records, cells, cell, is_open = [], [], "", False
    for n, line in enumerate(lines):
        if not is_open:
            if line == "":
                continue
            cells, cell = [], ""
        else:
            cell += "\n"
        at, start = 0, not is_open
        while True:
            if start:
                cell, start = "", False
                if line[at:at + 1] == '"':
                    at, is_open = at + 1, True
            if is_open:
                if at == len(line):
                    break
                c, after = line[at], line[at + 1:at + 2]
                if c == '"' and after == '"':
                    cell, at = cell + '"', at + 2
                elif c == '"' and after in ("", ","):
                    at, is_open = at + 1, False
                else:
                    cell, at = cell + c, at + 1
            elif at == len(line):
                break
            elif line[at] == ",":
                cells.append(cell)
                at, start = at + 1, True
            else:
                cell, at = cell + line[at], at + 1
        if not is_open:
            records.append(cells + [cell])
    return records + ([cells + [cell]] if is_open else [])


@pytest.mark.parametrize("split_bytes", [24, 1 << 20])
def test_records_equal_a_sequential_reader(spark, tmp_path, split_bytes):
    rnd = random.Random(split_bytes)
    pieces = ['"', '""', ",", "a", "b", "\n", "\r\n", ' "', 'x"y', '",', ',"', "\r", "日"]
    files = []
    for k in range(8):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 160)))
        if k % 2:  # closed quotes, so that several records remain
            text = "\n".join(",".join(rnd.choice(["a", '"b,\n\nc"', '"d""\n"', 'p"q', "", '"r"s"', '""']) for _ in range(rnd.randrange(1, 5)))
                             for _ in range(rnd.randrange(1, 30)))
        files.append(text)
        (tmp_path / f"f{k:02}.csv").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = csv_records(spark, str(tmp_path)).orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = [(n, row, cells) for n, text in enumerate(files, 1) for row, cells in enumerate(plain_records(text))]
    assert [(r.file_no, r.file_row, r.cells) for r in got] == [
        (sorted({n for n, *_ in want}).index(n) + 1, row, cells) for n, row, cells in want]
    assert [r.row_idx for r in got] == list(range(len(want)))


def test_stray_quotes_keep_all_cells(spark, tmp_path):
    path = tmp_path / "stray.csv"
    path.write_text('h,i\np"q,r"s,t\na"b,c\nd,e"f,g\n')
    sheet = read_csv_sheet(spark, str(path), "s")
    rows = [tuple(r)[2:] for r in sheet.rows.orderBy("row_idx").collect()]
    assert rows == [('p"q', 'r"s', "t"), ('a"b', "c", ""), ("d", 'e"f', "g")]
    assert csv_metadata(spark, str(path)).first()[1:3] == (4, 3)


def test_one_file_is_many_tasks_and_long_cells_fit(spark, tmp_path):
    path = tmp_path / "long.csv"
    cell = '"' + 'x""y,\n' * 40_000 + '"'
    path.write_text("a,b\n" + f"1,{cell}\n" + "".join(f"{k},plain\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert spark.read.text(str(path), lineSep="\n").rdd.getNumPartitions() > 8
        records = csv_records(spark, str(path))
        assert records.count() == 5002
        assert records.filter("row_idx = 1").first().cells[1] == 'x"y,\n' * 40_000
        assert records.filter("row_idx = 5001").first().cells == ["4999", "plain"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("lines_of_batch", [1, 3])
def test_records_cross_batches_and_no_text_is_shuffled(spark, tmp_path, monkeypatch, lines_of_batch):
    rnd = random.Random(lines_of_batch)
    texts = ["\n".join(",".join(rnd.choice(["a", '"b,\n\nc"', '"\n\n,""1"",",', 'p"q', "", '"r"s"', "\n"]) for _ in range(4))
                       for _ in range(25)) + end for end in ("", "\n\n", '\n"open\n,x\n\n')]
    for k, text in enumerate(texts):
        (tmp_path / f"f{k}.csv").write_text(text)
    plans = []

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *args)

    written = csvio.materialize
    monkeypatch.setattr(csvio, "materialize", seen)
    size, split = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size), spark.conf.get(split)
    spark.conf.set(size, str(lines_of_batch))
    spark.conf.set(split, "200")
    try:
        got = csv_records(spark, str(tmp_path)).orderBy("row_idx").collect()
    finally:
        spark.conf.set(size, before[0])
        spark.conf.set(split, before[1])
    want = [(n, row, cells) for n, text in enumerate(texts, 1) for row, cells in enumerate(plain_records(text))]
    assert [(r.file_no, r.file_row, r.cells) for r in got] == want
    scans = [p for p in plans if "FileScan text" in p]
    assert scans and not any("Exchange hashpartitioning" in p or "Window" in p for p in scans)
    groups = [p for p in plans if "collect_list" in p]
    assert len(groups) == 1 and "part#" in groups[0]
