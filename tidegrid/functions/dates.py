"""Date normalisation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid import lexicon as lx
from tidegrid.functions.cells import trim_ws


def _date(c: Column) -> Column:
    """The date of a cell in one of the accepted layouts, else null.

    Every part is named once, as nothing is shared inside of branches.
    """
    v = trim_ws(c)
    roc_year, short_year = F.substring_index(v, ".", 1), F.right(v, F.lit(2))
    century = F.when(short_year < str(lx.TWO_DIGIT_YEAR_PIVOT), "20").otherwise("19")
    iso = (
        F.when(v.rlike(lx.YMD_PATTERN), F.translate(v, "/", "-"))
        .when(v.rlike(lx.ROC_PATTERN), F.concat(
            (roc_year.try_cast("int") + lx.ROC_EPOCH).cast("string"),
            F.translate(F.substr(v, F.length(roc_year) + 1), ".", "-")))
        .when(v.rlike(lx.MDY_PATTERN), F.concat(
            century, short_year, F.lit("-"), F.translate(F.left(v, F.length(v) - 3), "/", "-")))
    )
    return iso.try_cast("date")


def is_normal_date(c: Column) -> Column:
    """Whether ``normalize_date`` has a result; nothing is formatted."""
    return _date(c).isNotNull()


def normalize_date(c: Column) -> Column:
    """``YYYY/MM/DD`` or null when the cell is not one of the accepted layouts."""
    return F.replace(_date(c).cast("string"), F.lit("-"), F.lit("/"))
