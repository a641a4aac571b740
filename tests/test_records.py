"""Stored records and listings."""

from pyspark.sql import functions as F

from tidegrid.operators import records as rc
from tidegrid.operators import usage as us


def test_details_round_trip_and_old_form(spark):
    texts = [
        '{"columns":[{"name":"a","completeness_ratio":0.5}],"row_distribution":{"high":1,"medium":2,"low":3},"total_rows":6,"filename":"f"}',
        ' [{"name":"b","completeness_ratio":1.0}]',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    new, old = [r.d for r in df.select("i", rc.parse_details(F.col("t")).alias("d")).orderBy("i").collect()]
    assert (new.columns[0].name, new.row_distribution.low, new.total_rows) == ("a", 3, 6)
    assert (old.columns[0].name, old.total_rows) == ("b", None)


def test_ownership_and_locale_map(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8)], "id int, user_id int")
    assert us.owned_by(rows, 1, 7).count() == 1 and us.owned_by(rows, 1, 8).count() == 0
    texts = spark.createDataFrame([("en", "k1", "v1"), ("en", "k2", "v2"), ("zh-TW", "k1", "w")],
                                  "locale string, key string, value string")
    assert us.locale_map(texts, "en").first().texts == {"k1": "v1", "k2": "v2"}
    assert us.search_translations(texts, "en", "V2").count() == 1
