"""Dates and numbers as pages print them, against plain loops over the same rules."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from payguard.functions import printed as P
from pyspark.sql import functions as F

D = dt.date
# text: (run, day first, month first, ambiguous), in order
DATES = {
    "09/03/2024": [("09/03/2024", D(2024, 3, 9), D(2024, 9, 3), True)],
    "09-03-2024": [("09-03-2024", D(2024, 3, 9), D(2024, 9, 3), False)],
    "9.3.24 and 13/02/24": [("9.3.24", D(2024, 3, 9), D(2024, 9, 3), True), ("13/02/24", D(2024, 2, 13), None, False)],
    "Date: 2024/03/09": [("2024/03/09", D(2024, 3, 9), D(2024, 3, 9), False)],
    "2024-03-09, 24-03-09": [("2024-03-09", D(2024, 3, 9), D(2024, 3, 9), False)],
    "Invoice Date: 30 Jul 2026": [("30 Jul 2026", D(2026, 7, 30), D(2026, 7, 30), False)],
    "09 Mar 2024": [("09 Mar 2024", D(2024, 3, 9), D(2024, 3, 9), False)],
    "Mar 9, 2024": [("Mar 9, 2024", D(2024, 3, 9), D(2024, 3, 9), False)],
    "September 3 2024": [("September 3 2024", D(2024, 9, 3), D(2024, 9, 3), False)],
    "9 SEPT., 2024": [("9 SEPT., 2024", D(2024, 9, 9), D(2024, 9, 9), False)],
    "Floor 6 Building 2026": [],
    "09/03.2024 and 1/2/3": [],
    "31/02/2024": [("31/02/2024", None, None, False)],
    "due 1/2/2024, issued Jan 5, 2024; 2023.12.31 to 05 May 2024": [
        ("05 May 2024", D(2024, 5, 5), D(2024, 5, 5), False), ("Jan 5, 2024", D(2024, 1, 5), D(2024, 1, 5), False), ("2023.12.31", D(2023, 12, 31), D(2023, 12, 31), False), ("1/2/2024", D(2024, 2, 1), D(2024, 1, 2), True),
    ],
    "x09/03/2024 9/3/20245 09/03/2024x": [],
    "": [],
}


def test_all_runs_in_order(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string")
    for r in df.select("t", P.date_runs(F.col("t")).alias("d")).collect():
        assert [(x.text, x.day_first, x.month_first, x.ambiguous) for x in r.d] == DATES[r.t], r.t
    assert df.limit(1).select(P.date_runs(F.lit(None).cast("string")).alias("d")).first().d is None


VALUES = {
    "123": {"123"}, "0": {"0"}, "1,234.56": {"1234.56"}, "1.234,56": {"1234.56"}, "1 234,50": {"1234.5"}, "12,34,567.80": {"1234567.8"}, "1,234": {"1.234", "1234"}, "1.234": {"1.234", "1234"},
    "1,234,567": {"1234567"}, "1'234.5": {"1234.5"}, "0.125": {"0.125"}, "12.5": {"12.5"}, "1234.567": {"1234.567"}, "12,5": {"12.5"}, "1 234": {"1234"},
}


@pytest.mark.parametrize("run", VALUES)
def test_values_of_a_run(spark, run):
    df = spark.createDataFrame([("a " + run + ", b",)], "t string").select(F.regexp_extract_all("t", F.lit(P.NUMBER), F.lit(0)).alias("r"))
    assert df.first().r == [run]
    got = df.select(P.number_values(F.col("r")[0]).alias("v")).first().v
    assert {x.normalize() for x in got} == {Decimal(x) for x in VALUES[run]}


def test_numbers_met_by_value(spark):
    pages = spark.createDataFrame([(1, "No 91234, total 1.234,50 or 1,234.50; x123 123x 12.5% v1.2.3 24.07.00 5 12"), (2, ""), (3, None), (4, "123")], "id long, page string")
    asked = [(1, "123"), (1, "91234"), (1, "1234.5"), (1, "12.5"), (1, "1234"), (1, "1.2"), (2, "0"), (3, "1"), (4, "123.00"), (5, "123")]
    values = spark.createDataFrame([(i, v, Decimal(v)) for i, v in asked], "id long, field string, value decimal(38,6)")
    got = {(r.id, r.field): r.runs for r in P.on_page(values, pages, "id", "page").collect()}
    assert got == {(1, "123"): 0, (1, "91234"): 1, (1, "1234.5"): 2, (1, "12.5"): 1, (1, "1234"): 0, (1, "1.2"): 0, (2, "0"): 0, (3, "1"): 0, (4, "123.00"): 1, (5, "123"): 0}


def occurs(value: str, text: str) -> bool:
    """The renderings of a value, looked for one by one."""
    bare = re.sub(r"(?<=\d)[,    ](?=\d)", "", text)
    d = Decimal(value)
    short = format(d.normalize(), "f")
    forms = {short}
    if d == d.quantize(Decimal("0.01")):
        forms |= {f"{d:.2f}", f"{d:,.2f}"}
    return any(f in text or f in bare for f in forms)


def test_occurs_under_any_grouping(spark):
    texts = ["Total 16,76,976.00", "Total 1,676,976", "1676976.5", "91234", "1 234.50", "12.50 EUR", "", "0.5", "1.234,50"]
    rows = [(v, Decimal(v), t) for v in ("1676976", "1676976.50", "123", "1234.5", "12.5", "0.5", "1000", "1234.50") for t in texts]
    df = spark.createDataFrame(rows, "v string, value decimal(38,6), t string")
    for r in df.select("v", "t", P.occurs(F.col("value"), F.col("t")).alias("o")).collect():
        assert r.o == occurs(r.v, r.t), (r.v, r.t)


def test_parts_of_dates_and_document_numbers_are_no_numbers(spark):
    """The 09 of 1997-09-06 is not the amount 9, nor is the 560910 of INV-560910-CLN an amount."""
    pages = spark.createDataFrame([(1, "Invoice INV-560910-CLN Date: 1997-09-06 or 01/02/1999 Tax 9.00 Total 909.70")], "id int, page string")
    values = spark.createDataFrame([(1, f, f) for f in ("9", "560910", "6", "1997", "1", "1999", "909.7")], "id int, field string, value string")
    got = {r.field: r.runs for r in P.on_page(values, pages, "id", "page").collect()}
    assert got == {"9": 1, "560910": 0, "6": 0, "1997": 0, "1": 0, "1999": 0, "909.7": 1}


def test_a_date_is_made_once_a_run(spark):
    """Runs are looked for once a page, not again for each number run; dates are made without a text between."""
    plan = spark.createDataFrame([("a",)], "t string").select(P.date_runs(F.col("t")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4 and "format_string" not in plan and "gettimestamp" not in plan
    text = "0050-01-02 29.02.1999 29.02.2000 31/04/24 00.01.2000 30/13/2001"
    d = spark.createDataFrame([(text,)], "t string").select(P.date_runs(F.col("t")).alias("d")).first().d
    assert [str(x.day_first) for x in d] == ["2050-01-02", "None", "2000-02-29", "None", "None", "None"] and [str(x.month_first) for x in d] == ["2050-01-02", *["None"] * 5]
