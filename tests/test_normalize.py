from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revisit_spark.functions import moments
from revisit_spark.functions import normalize as n


def one(spark, raw, made):
    got = spark.createDataFrame([(raw,)], "x string").select(made(F.col("x")).alias("r")).first().r
    return got if not hasattr(got, "issues") else (got.value, [i.code for i in got.issues])


@pytest.mark.parametrize(
    "raw,value,codes",
    [("$1,234.56", "1234.56", []), ("1.234,56", "1234.56", []), ("(1,234.56)", "-1234.56", ["NEGATIVE_AMOUNT"]), ("1,23,456.78", "123456.78", []), ("12.345", "12345", []), ("1.5", "15", []), ("N/A", None, []), ("-", None, []), ("words", None, ["INVALID_NUMBER"]), ("=2+2", None, ["INVALID_NUMBER"]), ("1000000000000", None, ["INVALID_NUMBER"]), (None, None, [])],
)
def test_money(spark, raw, value, codes):
    assert one(spark, raw, n.money) == (None if value is None else Decimal(value), codes)


def test_money_rounds_half_up(spark):
    assert one(spark, "1.235", lambda x: n.money(x, decimal=".")) == (Decimal("1.24"), ["NUMBER_ROUNDED"])


@pytest.mark.parametrize("raw,value,codes", [(" YES ", True, []), ("x", True, []), ("Warranty", True, []), ("n", False, []), (None, False, []), ("perhaps", False, ["UNKNOWN_ENUM_VALUE"])])
def test_booleans(spark, raw, value, codes):
    assert one(spark, raw, n.boolean) == (value, codes)


@pytest.mark.parametrize("raw,order,value,codes", [("2026-01-31", "ambiguous", date(2026, 1, 31), []), ("03/04/2025", "ambiguous", None, ["AMBIGUOUS_DATE_FORMAT"]), ("03/04/2025", "dmy", date(2025, 4, 3), []), ("03/04/2025", "mdy", date(2025, 3, 4), []), ("1989-12-31", "dmy", None, ["DATE_OUT_OF_RANGE"]), ("45678", "dmy", None, ["INVALID_DATE"]), (" ", "dmy", None, ["MISSING_REQUIRED_FIELD"]), ("5 Mar 2025", "ambiguous", date(2025, 3, 5), [])])
def test_dates(spark, raw, order, value, codes):
    assert one(spark, raw, lambda x: n.date(x, "2026-06-01", order)) == (value, codes)


def test_text(spark):
    assert one(spark, "  café ‮<b>\n\tx ", n.text) == ("café <b>\n\tx", [])
    value, codes = one(spark, "é" * 100, lambda x: n.text(x, 32))
    assert value.endswith(n.MARKER) and len(value.encode()) <= 32 and codes == ["FIELD_TOO_LONG"]
    assert one(spark, " ​ ", n.text) == (None, [])


def test_names_and_phones(spark):
    assert one(spark, "  ACME, Incorporated. ", n.name) == "acme"
    assert one(spark, "Straße GmbH & Co", n.name) == "strasse gmbh co"
    assert one(spark, "llc", n.name) == "llc"
    assert one(spark, "+1 (415) 200-1234", n.phone) == "+14152001234"
    assert one(spark, "+1 (415) 100-1234", n.phone) is None
    assert one(spark, "call me", n.phone) is None


@pytest.mark.parametrize("raw", ["=1", "+1", "-1", "@x", "\tx", "\rx"])
def test_csv_safe(spark, raw):
    assert one(spark, raw, n.csv_safe) == "'" + raw


ISO = ["2024-01-05T", "2024-01-05T09.5", "2024-01-05T0930", "2024-01-05T09:3", "2024-W02", "2024-W02-3", "2024W023T0930", "2024W02T09", "2024-W53-1", "2020-W53-1", "2024-W02-09", "20240105T093000,123+0530", "2024-01-05T09:30:00.1234567", "2024-01-05x09", "2024-01-05T09+05", "2024-01-05T09:30+05:30:15", "2024-01-05T24:00", "2024-01-05T09:30:00.", "2024-01-05T09:30,5", "2024-01-05T093000+05:30"]
ISO += ["2024-01-05T09:30:00-0000", "2024-01-05T09:30+24:00", "0000-01-01", "2024-01-05T09:3000", "20240105 09:30", "2024-W02-0", "2024-W00-1", "2024-01-05T-05:00", "2024-02-30", "20240230", "2024-01-05T09:60", "20240105", "2024-01-05T09:30:00Z", "1999-W52-7T23:59:59.999999-11:59", "2024-13-01", "2024-01-05 09:30:00+02", "2024", "2024-01", "2024-005"]


def test_iso_forms_as_the_standard_library_reads_them(spark):
    from datetime import datetime

    got = spark.createDataFrame([(x,) for x in ISO], "x string").select("x", moments.written(F.col("x"), F.lit("dmy")).alias("w")).collect()
    for r in got:
        try:
            d = datetime.fromisoformat(r.x.replace("Z", "+00:00"))
            expect = d.replace(tzinfo=None), None if d.tzinfo is None else int(d.utcoffset().total_seconds())
        except ValueError:
            expect = None, None
        assert ((None, None) if r.w is None or r.w.naive is None else (r.w.naive, r.w.ahead)) == expect, r.x


@pytest.mark.parametrize("raw,format,value", [("18_09_2026", "%d_%m_%Y", (2026, 9, 18)), ("8_9_2026", "%d_%m_%Y", (2026, 9, 8)), ("18092026", "%d%m%Y", (2026, 9, 18)), ("18.09.26", "dd.MM.yy", (2026, 9, 18)), ("9/18/91", "%m/%d/%y", (1991, 9, 18)), ("on 18 sep 2026", "on %d %b %Y", (2026, 9, 18)), ("2026-09-18", "%d_%m_%Y", None), ("day 261 of 2026", "day %j of %Y", (2026, 9, 18)), ("09/18/2026 11:05 PM -0930", "%m/%d/%Y %I:%M %p %z", (2026, 9, 18)), ("09/18/2026 11:05 PM", "%m/%d/%Y %I:%M %p %z", None)])
def test_formats(spark, raw, format, value):
    assert one(spark, raw, lambda x: n.date(x, "2026-06-01", explicit=format)) == ((date(*value), []) if value else (None, ["INVALID_DATE"]))


def test_odd_formats_are_errors():
    for format in ("%d %Q", "100%"):
        with pytest.raises(ValueError):
            moments.spark_format(format)
    assert moments.spark_format("at %I o'clock %p") == ("'at' h 'o''clock' a", False)


def test_digits_of_other_scripts(spark):
    assert one(spark, "\u0663.\u0665\u0660", n.money) == (Decimal("3.50"), [])
    assert one(spark, "\u0967\u0968", n.integer) == (12, []) and one(spark, "1_000", n.integer) == (1000, []) and one(spark, "9e1", n.integer) == (90, []) and one(spark, "9e-1", n.integer) == (None, ["INVALID_NUMBER"])


@pytest.mark.parametrize("text,zone,first,second", [("2000-10-29 01:00", "America/New_York", 972795600, 972799200), ("2000-10-29 00:59", "America/New_York", 972795540, 972795540), ("2000-10-29 02:00", "America/New_York", 972802800, 972802800), ("2000-04-02 02:30", "America/New_York", 954660600, 954660600), ("2020-04-05 01:45", "Australia/Lord_Howe", 1586011500, 1586013300), ("2000-10-28 12:00", "UTC", 972734400, 972734400)])
def test_hours_that_come_twice(spark, text, zone, first, second):
    at = lambda later: one(spark, text, lambda x: F.unix_seconds(n.moment(x, zone, later=later)["value"]))
    assert (at(False), at(True)) == (first, second)
