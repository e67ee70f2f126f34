import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.calculator import calculate, calculate_column
from docquarry.functions.citations import citation, parse_citations


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    said = ["a b   c", "soft­ hy‑phen", "zero​width﻿", "q;", "x²½", None]
    assert column(spark, said, tx.normalize) == ["a b c", "soft hy-phen", "zerowidth", "q;", "x²½", None]


def test_keyword_tokens(spark):
    assert column(spark, ["US$1,234 Grab's GMV-growth", "", None, "Éa"], tx.keyword_tokens) == [["us", "1", "234", "grab", "s", "gmv", "growth"], [], [], ["a"]]


def test_values(spark):
    cells = ["12", "(1,234.5)", "US$5", "-", "—", "2025", "1999", "12%", "(3)%", "abc", "S$1.0"]
    assert column(spark, cells, tx.is_value) == [True, True, True, True, True, False, False, True, True, False, True]


def test_title(spark):
    assert column(spark, ["KEY INFORMATION OF THE COMPANY.", "Mixed Case.", "ITEM", "A VIEW OF IT"], tx.title) == ["Key Information of the Company", "Mixed Case", "Item", "A View of It"]


def test_numbers(spark):
    said = ["22,938,469 in FY2025", "1.50 and 2.00", "December 31, 2025 had 2025 and 2,025", "none", ""]
    assert [sorted(x) for x in column(spark, said, tx.numbers_in)] == [["22938469"], ["1.5", "2"], ["2025"], [], []]


def test_number_check_and_review(spark):
    rows = spark.createDataFrame([("5 and 7", "5 [x, p.7]", "correct"), ("5", "6", "correct"), ("no", "5", "wrong"), ("5", "5", "wrong")], "g string, a string, grade string")
    check = tx.number_check(F.col("g"), F.col("a"))
    got = rows.select(check.alias("c"), tx.needs_review(F.col("grade"), check).alias("r")).collect()
    assert [(tuple(r["c"]) if r["c"] else None, r["r"]) for r in got] == [((1, 2), False), ((0, 1), True), (None, False), ((1, 1), True)]


def test_grades(spark):
    said = ['x {"grade": " Correct", "reason": "ok "} y', '{"grade": "odd"}', "none", '{"grade": ']
    assert [r["grade"] for r in column(spark, said, tx.parse_grade)] == ["correct", "error", "error", "error"]


def test_snippets(spark):
    rows = spark.createDataFrame([("Revenue ... rose", "revenue  then\nROSE"), ("rose...revenue", "revenue rose"), ("", "x"), ("a...a", "a"), ("a.b%", "xa.b%")], "s string, t string")
    assert [r[0] for r in rows.select(tx.snippet_in(F.col("s"), F.col("t"))).collect()] == [True, False, False, False, True]


CITED = {
    "[Sea, FY2025, p.12]": [("Sea", 2025, ["12"])],
    "[Sea, FY 2025, pp.12-14, F-3 and 20]": [("Sea", 2025, ["12", "13", "14", "F-3", "20"])],
    "[Grab, FY2024, pp. F-3–F-5]": [("Grab", 2024, ["F-3", "F-4", "F-5"])],
    "a [b [Sea, FY2025, p.1] c] [Grab, FY2024, p.2]": [("Sea", 2025, ["1"]), ("Grab", 2024, ["2"])],
    "[Sea, FY2025, p.14-12]": [], "[Sea, FY2025, p.1-99]": [], "[Sea, FY2025, s152]": [], "[Sea, FY2025, p.iv]": [],
    "[Sea, 2025, p.1]": [], "[Sea FY2025 p.1]": [], "[Sea, FY2025, p.1, x]": [], "[Sea, FY2025, p.]": [], "": [],
}


def test_citations(spark):
    got = column(spark, list(CITED), parse_citations)
    assert [[(c["company"], c["year"], c["pages"]) for c in x] for x in got] == list(CITED.values())


def test_citation_round_trip(spark):
    got = spark.range(1).select(parse_citations(citation(F.lit("Sea"), F.lit(2025), F.array(F.lit("3"), F.lit("F-4")))).alias("c")).first()["c"]
    assert [(c["company"], c["year"], c["pages"]) for c in got] == [("Sea", 2025, ["3", "F-4"])]


@pytest.mark.parametrize(("said", "result"), [("1 + 2 * 3", "7"), ("1,234 + 1", "1235"), ("10 / 4", "2.5"), ("2 ** 10", "1024"), ("-(3 - 5)", "2"), ("1 / 3", "0.333333"), ("(22,938 - 16,820) / 16,820 * 100", "36.373365"), ("1e300", str(int(1e300))), ("-0.0000001", "-0")])
def test_calculator(said, result):
    assert calculate(said) == result


@pytest.mark.parametrize("said", ["1 / 0", "", " ", None, "__import__('os')", "a + 1", "True + 1", "1 if 1 else 2", "5 % 2", "7 // 2", "1 < 2", "2 ** 1000", "9 ** 99", "(-8) ** 0.5", "1,2345", "1" * 201, "(" * 150, "[1]", "'a' * 9"])
def test_calculator_errors(said):
    assert calculate(said).startswith("Error: ")


def test_calculator_column(spark):
    assert column(spark, ["1+1", None, "x"], calculate_column)[0] == "2"
