"""The full search for near values: pairs against brute force, and what its steps send out."""

import random
import re

from pyspark.sql import functions as F

from tidegrid.operators import duplicates as du
from tidegrid.session import materialize


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _values(spark, columns):
    rows = [(f"s{i}", i, v, at) for i, vs in enumerate(columns) for at, v in enumerate(vs)]
    return materialize(spark.createDataFrame(rows, "sheet_id string, col_idx int, value string, first_row long"))


def test_each_near_pair_comes_once(spark):
    rnd = random.Random(11)

    def text(letters, lo, hi):
        return "".join(rnd.choice(letters) for _ in range(rnd.randint(lo, hi)))

    columns = [
        # Runs, alternations and shifts: pairs with more than one way to be edited.
        {text("ab", 0, 9) for _ in range(120)},
        {"x" + text("abc", 0, 5) + "yy" for _ in range(90)},
        {text("é日a\U0001F600", 1, 4) for _ in range(60)},
        # Both sides of the limit between short and long values.
        {"k" * rnd.randint(28, 35) + text("ab", 0, 3) for _ in range(60)},
    ]
    columns = [sorted(vs) for vs in columns]
    found = [tuple(r) for r in du.all_near_pairs(_values(spark, columns)).collect()]
    want = {
        (f"s{i}", i, a, b) for i, vs in enumerate(columns) for a in range(len(vs)) for b in range(a + 1, len(vs))
        if abs(len(vs[a]) - len(vs[b])) <= 2 and _distance(vs[a], vs[b]) <= 2
    }
    assert len(found) == len(set(found)) and set(found) == want


def test_values_of_one_row_are_one_row_in_pairs(spark):
    rows = [("s", 0, "Acme 1", 0), ("s", 0, "Acme 2", 0), ("s", 0, "Acme 3", 1)]
    values = materialize(spark.createDataFrame(rows, "sheet_id string, col_idx int, value string, first_row long"))
    assert [tuple(r) for r in du.all_near_pairs(values).collect()] == [("s", 0, 0, 1)]


def test_pairs_are_counted_where_they_meet(spark):
    values = _values(spark, [[f"Acme {i} Co." for i in range(50)]])
    plan = du.near_neighbours(values, du.all_near_pairs(values))._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert shuffles and not any("row1" in x or "row2" in x for x in shuffles)


def test_keys_are_made_only_where_values_differ(spark):
    values = _values(spark, [[f"Customer of the north {i:04d}" for i in range(0, 1000, 7)]])
    forked = du._forks(values).select(F.bit_count("heads").alias("h"), F.bit_count("tails").alias("t"))
    # The 21 shared characters at the beginning give no position, and two deletions would leave 300 texts a value.
    assert forked.count() == 143 and forked.agg(F.max("h"), F.max("t")).first()[:] <= (5, 5)
