"""Presentation of export tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import MISSING_TEXT

# Which columns are shown as money, whole numbers and percent, and how.
MONEY_COLUMNS = ["open_price", "close_price", "avg_price", "min_price", "max_price"]
WHOLE_COLUMNS = ["sold", "total_restocked", "avg_stock", "turnover"]
PERCENT_COLUMNS = ["price_change_frac"]
MONEY_SIGN = " ₽"

WIDTH_MARGIN = 2


def format_report(df: DataFrame) -> DataFrame:
    """Known columns as display text. Money and whole numbers group their thousands, percents do not."""
    shown = {c: F.concat(F.format_number(c, 2), F.lit(MONEY_SIGN)) for c in MONEY_COLUMNS}
    shown |= {c: F.format_number(c, 0) for c in WHOLE_COLUMNS}
    shown |= {c: F.concat(F.format_string("%.2f", F.col(c) * 100), F.lit("%")) for c in PERCENT_COLUMNS}
    shown = {c: F.when(F.col(c).isNotNull(), text) for c, text in shown.items() if c in df.columns}
    return df.withColumns(shown)


def plain_number(value: Column) -> Column:
    """Text of a finite double in digits without an exponent, with at least one decimal place.

    The shortest text that gives the double back has at most 17 digits. Where it has an exponent,
    its digits are shifted by as many places.
    """
    text = value.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    whole, rest = (F.regexp_extract(text, r"^-?(\d+)\.(\d+)E(-?\d+)$", i) for i in (1, 2))
    digits = F.concat(whole, F.when(rest == "0", "").otherwise(rest))
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    size = F.length(digits)
    zeros = F.lit("0")
    large = F.when(power + 1 >= size, F.concat(F.rpad(digits, power + 1, zeros), F.lit(".0"))).otherwise(
        F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, size))
    )
    small = F.concat(F.lit("0."), F.repeat(zeros, -power - 1), digits)
    shifted = F.concat(sign, F.when(power < 0, small).otherwise(large))
    return F.when(text.contains("E"), shifted).otherwise(text)


def _text(column: str, kind: str) -> Column:
    value = F.col(column)
    text = plain_number(value) if kind == "double" else value.cast("string")
    return F.coalesce(text, F.lit(MISSING_TEXT))


def column_widths(df: DataFrame) -> DataFrame:
    """Display width per column: the longest text or the heading, and a margin."""
    widths = [
        (
            F.greatest(F.coalesce(F.max(F.length(_text(c, kind))), F.lit(0)), F.lit(len(c)))
            + WIDTH_MARGIN
        ).alias(c)
        for c, kind in df.dtypes
    ]
    return df.agg(*widths).unpivot([], df.columns, "column", "width")
