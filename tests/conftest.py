import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidegrid.session import local_session  # noqa: E402
from tidegrid.sheet import Sheets, header_table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_sheet(spark):
    def make(headers, rows, sheet_id="s", **annotations):
        names = ", ".join(f"c{i} string" for i in range(len(headers)))
        data = [
            (sheet_id, i, *(list(r) + [None] * (len(headers) - len(r)))) for i, r in enumerate(rows)
        ]
        df = spark.createDataFrame(data, f"sheet_id string, row_idx long, {names}")
        return Sheets(df, header_table(spark, {sheet_id: headers}), len(headers), **annotations)

    return make


@pytest.fixture
def cells(spark):
    """Evaluate a column expression over literal strings."""
    def run(values, expression):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        out = df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
        return [row.r for row in out]

    return run


def rows_of(sheets):
    return [tuple(r)[2:] for r in sheets.rows.orderBy("sheet_id", "row_idx").collect()]
