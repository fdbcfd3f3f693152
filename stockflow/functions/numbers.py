"""Numbers, flags and the measures derived from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import as_col, strip_ws

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def nan_to_null(column: Column | str) -> Column:
    value = as_col(column)
    return F.when(~F.isnan(value), value)


def to_number(column: Column | str, default: float | None = None) -> Column:
    """Number written in a text; anything else is missing, or the default."""
    text = strip_ws(column)
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def to_flag(column: Column | str) -> Column:
    """Boolean; a missing or unreadable flag is true."""
    return F.coalesce(as_col(column).try_cast("boolean"), F.lit(True))


def round_to(column: Column | str, places: int) -> Column:
    """Rounding to even on the scaled value."""
    scale = float(10**places)
    return F.rint(as_col(column) * scale) / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with signed infinity over zero; 0/0 is missing."""
    infinity = F.lit(float("inf"))
    return (
        F.when((denominator == 0) & (numerator > 0), infinity)
        .when((denominator == 0) & (numerator < 0), -infinity)
        .otherwise(F.try_divide(numerator, denominator))
    )


def sold_restocked(diff: Column | str) -> tuple[Column, Column]:
    """Outflow and inflow of a signed stock difference, both never negative."""
    zero = F.lit(0.0)
    return F.greatest(-as_col(diff), zero) + zero, F.greatest(as_col(diff), zero) + zero


def turnover(sold: Column | str, days: Column | str) -> Column:
    """Units sold per day with sales."""
    days = as_col(days)
    return as_col(sold) / F.when(days == 0, 1).otherwise(days)


def price_change(open_price: Column | str, close_price: Column | str) -> tuple[Column, Column]:
    """Price change over a period: absolute and in percent; missing or 0/0 counts as none."""
    first, last = as_col(open_price), as_col(close_price)
    absolute = F.coalesce(last - first, F.lit(0.0))
    percent = F.coalesce((ratio(last, first) - 1) * 100, F.lit(0.0))
    return absolute, percent


def price_change_fraction(open_price: Column | str, close_price: Column | str) -> Column:
    """Price change as a fraction with four places; missing stays missing."""
    first, last = as_col(open_price), as_col(close_price)
    return round_to(ratio(last - first, first), 4)


def price_differs(price: Column | str, previous: Column | str) -> Column:
    """True where two known prices differ."""
    return F.coalesce(as_col(price) - as_col(previous), F.lit(0.0)) != 0


def exceeds(value: Column | str, mean: Column | str, factor: float) -> Column:
    """Spike test; without a mean there is no spike."""
    return F.coalesce(as_col(value) > as_col(mean) * F.lit(float(factor)), F.lit(False))


def classify_day(spike: Column | str, price_changed: Column | str) -> tuple[Column, Column]:
    """Class of a day and the emphasis with which a chart marks it."""
    spike, changed = as_col(spike), as_col(price_changed)
    label = (
        F.when(spike & changed, "spike+price change")
        .when(spike, "spike")
        .when(changed, "price change")
        .otherwise("ordinary")
    )
    return label, F.when(spike, 10).otherwise(5)
