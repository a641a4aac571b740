"""Literal cases of the cell predicates and date normalisation."""

from pyspark.sql import functions as F

from tidegrid.functions import cells as fx
from tidegrid.functions.dates import is_normal_date, normalize_date
from tidegrid.operators import anonymize as an


def test_format_types(cells):
    cases = {
        "DATE": ["2024-01-15", "2024/01/15", "113.1.5", "112.12.31", "12.1.5"],
        "NUMERIC": ["123", "-456", "1,234", "1,234,567", "3.14", ".5", "1,234.56", " 7 "],
        "BOOLEAN": ["true", "FALSE", "是", "否", "Y", "n"],
        "TEXT": ["hello world", "ABC公司", "mixed 123 text", "", "+5", "2024-13-01"],
    }
    flat = [(v, k) for k, vs in cases.items() for v in vs]
    assert cells([v for v, _ in flat], fx.format_type) == [k for _, k in flat]


def test_numbers(cells):
    yes = ["1.", "+5", "1e5", "NaN", "inf", "-Infinity", "1,2,3", " 12 ", "　12"]
    no = ["1d", "1e400", "12 3", "１２", "", "abc", "1f", "0x10"]
    assert cells(yes + no, fx.is_num) == [True] * len(yes) + [False] * len(no)


def test_currency(cells):
    yes = ["NT$ 5", "USD5", "$1,234.56", "5€", "¥7", "12"]
    no = ["三萬", "$", "NT$", "usd5", "同AH2"]
    assert cells(yes + no, fx.is_numeric_currency) == [True] * len(yes) + [False] * len(no)


def test_empty_includes_unicode_space(cells):
    assert cells(["", " ", "　", "\t\n", None, " ", "x"], fx.is_empty) == [True] * 6 + [False]


def test_brackets(cells):
    values = ["(abc（中文）", "X（a）(中)", "(v2)", "(A)", "(123)", "(abcdef)", "PI(IQC檢測)", "no"]
    assert cells(values, fx.has_cjk_bracket_note) == [True, False, False, False, False, False, True, False]
    assert cells(values, fx.has_inline_remark) == [False, True, False, False, False, True, True, False]


def test_placeholder_and_dates(cells):
    assert cells(["同AH2", "同 ah2", "Same as B3", "same as", "同2"], fx.is_placeholder) == [
        True, True, True, False, False]
    assert cells(["02-27-19", "3/15/20", "03.15.2020", "2024", "1-2-3"], fx.looks_like_date) == [
        True, True, True, False, False]


def test_normalize_date(cells):
    cases = {
        "2023/3/9": "2023/03/09", "2024-01-15": "2024/01/15", "113.1.5": "2024/01/05",
        "112.12.31": "2023/12/31", "111.6.15": "2022/06/15", "02-27-19": "2019/02/27",
        "12/31/20": "2020/12/31", "1/2/50": "1950/01/02", "not-a-date": None, "2023-02-30": None,
        "2023/1-2": None,
    }
    assert cells(list(cases), normalize_date) == list(cases.values())


def test_dates_are_found_without_formatting(cells):
    cases = {
        "0000-2-29": "0000/02/29", "1900-02-29": None, "2000/2/29": "2000/02/29", "99.2.29": None, "101.2.29": "2012/02/29",
        "13/1/20": None, "1-2/49": "2049/01/02", " 2024/01/5\u3000": "2024/01/05", "2024-00-01": None, "": None, "2024-1-1 x": None,
    }
    assert cells(list(cases), normalize_date) == list(cases.values())
    assert cells(list(cases), is_normal_date) == [v is not None for v in cases.values()]
    assert cells(["", " \u3000\n", None, " a "], fx.is_empty) == [True, True, True, False]


def test_suffix_strip(cells):
    values = ["台灣科技股份有限公司", "台灣科技有限公司", "台灣科技", "Acme Corp.", "Acme Co.", "Acme corp."]
    assert cells(values, fx.strip_suffix) == ["台灣科技"] * 3 + ["Acme", "Acme", "Acme corp."]


def test_split_last_remark(cells):
    values = ["PI-1(IQC檢測)", "A（備註）", "A(b)", "x(abcdef)y", "none"]
    assert cells(values, lambda c: fx.split_last_remark(c)[0]) == ["PI-1", "A", "A(b)", "x", "none"]
    assert cells(values, lambda c: fx.split_last_remark(c)[1]) == ["IQC檢測", "備註", None, "abcdef", None]


def test_levenshtein_threshold(spark):
    pairs = [("kitten", "sitting", 3), ("台北市", "台北", 1), ("hello", "hallo", 1), ("", "abc", 3)]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    assert all(r.d == r.n for r in df.select("n", F.levenshtein("a", "b").alias("d")).collect())


def test_anonymise(cells):
    pool = ["a", "b", "c"]
    out = cells(["Acme Holdings International X", "Acme Holdings International Y", "", None],
                lambda c: an.pseudonym(c, pool, "salt"))
    assert out[0] == out[1] and out[0] in pool and out[2:] == ["", None]
    words = {"同": "Like ", "小計": "Sum"}
    assert cells(["同A2 小計", "測試", "plain"], lambda c: an.strip_cjk(c, words)) == ["Like A2 Sum", None, "plain"]
    assert cells(["Client \n客戶.", "單價", " "], lambda c: an.translate_header(c, {" ": "Date"})) == [
        "Client", "單價", "Date"]
