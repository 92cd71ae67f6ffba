from datetime import date

import pytest
from pyspark.sql import functions as F

from payrecon.functions import cleaners as c


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_integer(spark):
    values = ["12", " 7 ", "12.0", "1e3", "-5", "12.5", "abc", "", None, "99999999999999999999", "9007199254740993"]
    assert run(spark, values, c.clean_integer) == [
        12, 7, 12, 1000, -5, None, None, None, None, None, 9007199254740993]
    assert run(spark, ["12.5", "-1.5"], lambda v: c.clean_integer(v, on_fraction="floor")) == [12, -2]
    with pytest.raises(Exception, match="not an integer"):
        run(spark, ["12.5"], lambda v: c.clean_integer(v, on_fraction="error"))
    with pytest.raises(ValueError):
        c.clean_integer(F.lit("1"), on_fraction="guess")


def test_float(spark):
    values = ["(100)", "1e5", "1.234,56", "1-2", "N/A", "$1,234.50", " none", "SAR 5", "-3.5", "", None, "<NA>", "x"]
    assert run(spark, values, c.clean_float) == [
        100.0, 15.0, 1.23456, None, None, 1234.5, None, 5.0, -3.5, None, None, None, None]


def test_date_serials(spark):
    values = ["43891", "59", "60", "20240201", "106752", "106753", "2024", "45000.75"]
    assert run(spark, values, c.clean_date) == [
        date(2020, 2, 29), date(1900, 2, 27), date(1900, 2, 27), date(2024, 2, 1), date(2192, 4, 8), None,
        date(1905, 7, 15), date(2023, 3, 14)]
    assert run(spark, ["43891"], lambda v: c.clean_date(v, excel_leap_adjust=False)) == [date(2020, 3, 1)]


def test_date_formats(spark):
    values = ["03/04/2024", "03/25/2024", "31/02/2024", "2024-2-9", "9-2-2024", "2024/02/09", "9.2.2024", "2.25.2024",
              "9 Feb 2024", "Feb 9 2024", "25/12/2024 1:02:03", "12/25/2024 1:02:03", "2024-02-09 10:11:12",
              "2024-02-09T10:11:12Z", "2024-02-09 10:11", "None", "NaN", "<NA>", "", "soon", None, "2024-02-31"]
    d = date(2024, 2, 9)
    assert run(spark, values, c.clean_date) == [
        date(2024, 4, 3), date(2024, 3, 25), None, d, d, d, d, date(2024, 2, 25), d, d, date(2024, 12, 25),
        date(2024, 12, 25), d, d, d, None, None, None, None, None, None, None]


@pytest.mark.parametrize("source, expected", [
    ("tamara", date(2024, 3, 4)), ("checkout_v1", date(2024, 3, 4)), ("checkout_v2", date(2024, 3, 4)),
    ("metabase", date(2024, 3, 4)), ("portal", date(2024, 4, 3)), ("bank", date(2024, 4, 3)), (None, date(2024, 4, 3)),
])
def test_date_source_formats_come_first(spark, source, expected):
    assert run(spark, ["03/04/2024"], lambda v: c.clean_date(v, source)) == [expected]


def test_tamara_time_format(spark):
    assert run(spark, ["3/4/2024 13:05"], lambda v: c.clean_date(v, "tamara")) == [date(2024, 3, 4)]
    assert run(spark, ["3/4/2024 13:05"], c.clean_date) == [None]


def test_time(spark):
    values = ["10:11:12", "9:05", "9:05 PM", "9:05:06 am", " 7:08 ", "0.5", ".25", "1.75", "0.999999", "24:00:00", "bad",
              "none", "<NA>", "", None]
    assert run(spark, values, c.clean_time) == [
        "10:11:12", "09:05:00", "21:05:00", "09:05:06", "07:08:00", "12:00:00", "06:00:00", "18:00:00", "23:59:59",
        None, None, None, None, None, None]


def test_string_and_text(spark):
    assert run(spark, ['="007"', " a\r\nb ", "x\x07y", "", None], c.clean_string) == ["007", "a b", "xy", "", None]
    assert run(spark, ["Tom &amp; Co  &lt;x&gt;", "&amp;lt;", "Ù†Ø¹", '&quot;q&quot;'], c.clean_text) == [
        "Tom & Co <x>", "<", "نع", '"q"']
    assert run(spark, ["a\nb\x00c"], c.strip_control) == ["abc"]


def test_boolean(spark):
    values = ["Yes", "TRUE", "1", "on", "Completed", "no", "F", "0", "OFF", "failure", "maybe", " yes", "", None]
    assert run(spark, values, c.clean_boolean) == [True] * 5 + [False] * 5 + [None] * 4


def test_uuid(spark):
    u = "12345678-1234-5678-1234-567812345678"
    bare = u.replace("-", "")
    values = [u, bare, "{" + u.upper() + "}", "urn:uuid:" + u, " " + bare + " ", "1234-5678" + bare[8:], bare[:-1], "nope",
              "URN:UUID:" + u, None]
    assert run(spark, values, c.clean_uuid) == [u] * 6 + [None] * 4


def test_registry(spark):
    assert c.cleaner_for("no such type") is c.clean_string
    c.register_cleaner("upper", lambda v, source=None: F.upper(v))
    try:
        assert run(spark, ["a"], c.cleaner_for("upper")) == ["A"]
    finally:
        del c.CLEANERS["upper"]
