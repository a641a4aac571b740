import random

import pytest

EDGE = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, hash string, `__x` int, "
        "`__id` int, score double, Predicted int, hits string, n_lines int, _n_lines int, label string, term string")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcde") for _ in range(4)) for _ in range(300)]
    line = "The same line in several documents, long enough to count."
    base = [rnd.choice(words) for _ in range(80)]
    near = list(base)
    near[5] = "other"
    rows = [
        (None, None), (None, "a text without id"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"),
        (5, "one"), (6, " ".join(base)), (7, " ".join(near)), (7, " ".join(base)), (8, " ".join(words * 40)),
        (9, line + "\nfirst"), (10, "  " + line.upper() + " \nsecond\n"), (11, line), (12, line + "\n" + line),
        (13, "x" * 200_000), (14, "é́ 日本語 🙂 <|endoftext|> \x00 \x1c  z"), (-3, "\n\n\n"), (4, "two"),
    ]
    full = [(i, t, None if k % 3 else "en", None if k % 2 else "s", *[None] * 12) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, EDGE).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
