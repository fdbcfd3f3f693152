"""Column functions on single values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import day
from stockflow.functions import dates, numbers, text
from stockflow.operators import report

INF = math.inf
FILE_TIME = day("2025-06-01 18:30")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("02.03.2025", "2025-03-02"),
        ("2/3/2025 14:30", "2025-03-02 14:30"),
        ("2025-03-02", "2025-03-02"),
        ("2025-03-02 00:00:00", "2025-03-02"),
        ("2025-03-02T07:08:09", "2025-03-02 07:08:09"),
        ("2-3-25", "2025-03-02"),
        ("2/13/2025", "2025-02-13"),
        ("20250302", "2025-03-02"),
        ("2 March 2025", "2025-03-02"),
        ("2 Mar 2025", "2025-03-02"),
        ("  02.03.2025 ", "2025-03-02"),
    ],
)
def test_as_of_is_read_from_the_cell(spark, given, expected):
    assert value(spark, dates.resolve_as_of(F.lit(given), F.lit(FILE_TIME))) == day(expected)
    assert value(spark, dates.as_of_source(F.lit(given))) == "cell"


@pytest.mark.parametrize("given", ["Остатки на 02.03.2025", "45718", "", "31.02.2025", None])
def test_as_of_falls_back_to_the_file(spark, given):
    cell = F.lit(given).cast("string")
    assert value(spark, dates.resolve_as_of(cell, F.lit(FILE_TIME))) == FILE_TIME
    assert value(spark, dates.as_of_source(cell)) == "file"


def test_dates(spark):
    stamp = F.lit("2025-03-02 14:30:00")
    assert value(spark, dates.parse_dt(stamp)) == day("2025-03-02 14:30")
    assert value(spark, dates.parse_dt(F.lit("nonsense"))) is None
    assert value(spark, dates.parse_dt(F.lit("02.03.2025"), ["yyyy-MM-dd", "dd.MM.yyyy"])) == day("2025-03-02")
    assert value(spark, dates.day(dates.parse_dt(stamp))) == day("2025-03-02")
    assert value(spark, dates.month_start(F.lit(2025), F.lit(3))) == day("2025-03-01").date()
    assert value(spark, dates.fmt_date(dates.parse_dt(stamp))) == "02/03/2025"


def test_codes_and_names(spark):
    code = F.lit("ab-12_c d")
    assert value(spark, text.norm_code(code)) == "AB12CD"
    assert value(spark, text.norm_code(code, drop="- ")) == "AB12_CD"
    assert value(spark, text.norm_name(F.lit("  Фильтр ДЕФЕКТ"))) == "фильтр"
    assert value(spark, text.norm_name(F.lit("Filter used"), ["used"])) == "filter"
    assert value(spark, text.norm_name(F.lit(None).cast("string"))) is None
    assert value(spark, text.item_key(F.lit("a"), F.lit(None).cast("string"))) == "a|nan"


def test_white_space_is_what_python_strips(spark):
    padding = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    assert value(spark, text.strip_ws(F.lit(f"{padding}a b{padding}"))) == "a b"
    assert set(text.WHITESPACE) == set(padding)


@pytest.mark.parametrize(
    ("given", "expected"),
    [("1,5", None), (" 3 ", 3), ("1e3", 1000), ("x", None), ("1d", None), ("nan", None), (".5", 0.5), ("-2.", -2)],
)
def test_to_number(spark, given, expected):
    assert value(spark, numbers.to_number(F.lit(given))) == expected
    assert value(spark, numbers.to_number(F.lit(given), default=0)) == (expected or 0)


@pytest.mark.parametrize(("given", "expected"), [("true", True), ("false", False), (None, True)])
def test_to_flag(spark, given, expected):
    assert value(spark, numbers.to_flag(F.lit(given).cast("string"))) is expected


@pytest.mark.parametrize(("given", "expected"), [(0.125, 0.12), (2.675, 2.68), (2.345, 2.35), (1.005, 1.0)])
def test_rounding(spark, given, expected):
    assert value(spark, numbers.round_to(F.lit(given), 2)) == expected


@pytest.mark.parametrize(
    ("first", "last", "percent", "fraction"),
    [(0, 5, INF, INF), (0, 0, 0, None), (None, 5, 0, None), (100, 110, 10, 0.1), (0, -5, -INF, -INF)],
)
def test_price_change(spark, first, last, percent, fraction):
    prices = F.lit(first).cast("double"), F.lit(last).cast("double")
    found = value(spark, numbers.price_change(*prices)[1])
    assert found == percent or abs(found - percent) < 1e-9
    assert value(spark, numbers.price_change_fraction(*prices)) == fraction


def test_small_rules(spark):
    sold, restocked = numbers.sold_restocked(F.lit(0.0))
    assert math.copysign(1, value(spark, sold)) == 1 and value(spark, restocked) == 0
    assert value(spark, numbers.turnover(F.lit(6.0), F.lit(0))) == 6
    assert value(spark, numbers.exceeds(F.lit(1.0), F.lit(None).cast("double"), 1.5)) is False
    assert value(spark, numbers.nan_to_null(F.lit(math.nan))) is None
    for spike, changed, label in [(True, True, "spike+price change"), (False, True, "price change")]:
        assert value(spark, numbers.classify_day(F.lit(spike), F.lit(changed))[0]) == label


def test_report(spark):
    frame = spark.createDataFrame(
        [("a", 1234.5, 1234.0, 0.0123), ("long name", None, 12345678.0, None)],
        "item_name string, avg_price double, total_restocked double, price_change_frac double",
    )
    shown = report.format_report(frame).first()
    assert shown[1:] == ("1,234.50 ₽", "1,234", "1.23%")
    widths = {r["column"]: r["width"] for r in report.column_widths(frame).collect()}
    assert widths == {"item_name": 11, "avg_price": 11, "total_restocked": 17, "price_change_frac": 19}


@pytest.mark.parametrize(
    ("cell", "stamp"),
    [
        ("March 2, 2025", "2025-03-02"),
        ("Mar 2 2025", "2025-03-02"),
        ("2 March 2025 10:00", "2025-03-02 10:00"),
        ("2 Mar, 2025 10:00:30", "2025-03-02 10:00:30"),
        ("2025-03-02T10:00:00Z", "2025-03-02 10:00"),
    ],
)
def test_worded_and_zoned_dates(spark, cell, stamp):
    frame = spark.createDataFrame([(cell,)], "cell string")
    assert frame.select(dates.parse_as_of("cell")).first()[0] == day(stamp)


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (12345678.5, "12345678.5"),
        (0.0001, "0.0001"),
        (1.5e-7, "0.00000015"),
        (-2.5e9, "-2500000000.0"),
        (1e22, "10000000000000000000000.0"),
        (1.0, "1.0"),
        (0.0, "0.0"),
        (5e-324, "0." + "0" * 323 + "49"),
    ],
)
def test_plain_numbers(spark, value, text):
    frame = spark.createDataFrame([(value,)], "v double")
    found = frame.select(report.plain_number(F.col("v"))).first()[0]
    assert float(found) == value and "E" not in found
    assert found == text or value == 5e-324


def test_percents_have_no_separator(spark):
    frame = spark.createDataFrame([(12.34, 1234.5), (None, None)], "price_change_frac double, avg_price double")
    shown = report.format_report(frame).collect()
    assert [tuple(r) for r in shown] == [("1234.00%", "1,234.50 ₽"), (None, None)]
