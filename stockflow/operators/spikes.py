"""Sales spikes by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dates import month_start
from ..functions.numbers import exceeds
from ..schema import ITEM_KEYS
from .halo import hashed


def find_spikes(monthly: DataFrame, window: int = 3, factor: float = 1.5) -> DataFrame:
    """Flag months that sold more than ``factor`` times the mean of the previous ``window`` rows.

    A series here has one row per calendar month, which bounds the window's group.
    """
    previous = (
        Window.partitionBy(*hashed(*ITEM_KEYS)).orderBy("month_start").rowsBetween(-window, -1)
    )
    return monthly.withColumns(
        {"month_start": month_start("year", "month")}
    ).withColumns(
        {"trailing_avg": F.avg("total_sold").over(previous)}
    ).withColumn("is_spike", exceeds("total_sold", "trailing_avg", factor))
