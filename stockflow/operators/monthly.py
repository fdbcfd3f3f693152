"""Monthly facts, price statistics and item totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import month_start
from ..functions.numbers import price_change, turnover
from ..schema import ITEM_KEYS, MONTH_KEYS, MONTHLY, TOTALS
from .daily import earliest, group_hashed, latest
from .tables import require


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.replace("\n", " ").split(",")]


def _total(column: str):
    return F.coalesce(F.sum(column), F.lit(0.0))


def monthly_price_range(daily: DataFrame) -> DataFrame:
    """Lowest and highest price per item, warehouse and month."""
    return daily.groupBy(*MONTH_KEYS).agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price")
    )


def monthly_open_close(daily: DataFrame) -> DataFrame:
    """First and last present price by date per item, warehouse and month."""
    return daily.groupBy(*MONTH_KEYS).agg(
        earliest("price", "dt").alias("open_price"), latest("price", "dt").alias("close_price")
    )


def monthly_summary(net: DataFrame) -> DataFrame:
    """Sales, restocks, availability and prices per item, warehouse and month, in one aggregate.

    The input holds one row per item, warehouse and time, so its rows are its distinct days.
    Its keys and time are present, hence its year and month: a filter on those two would reach
    only one branch of the halo and cost it the shared exchange.
    """
    absolute, percent = price_change("open_price", "close_price")
    return (
        group_hashed(require(net, [*ITEM_KEYS, "dt"]), MONTH_KEYS)
        .agg(
            earliest("item_name", "dt"),
            earliest("manufacturer", "dt"),
            _total("sold").alias("total_sold"),
            _total("restocked").alias("total_restocked"),
            F.count_if(F.col("sold") > 0).alias("sale_days"),
            F.avg("price").alias("avg_price"),
            F.count_if(F.col("stock") > 0).alias("in_stock_days"),
            latest("stock", "dt").alias("last_stock"),
            F.count("dt").alias("distinct_days"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            earliest("price", "dt").alias("open_price"),
            latest("price", "dt").alias("close_price"),
        )
        .withColumns(
            {
                "in_stock_days": F.least("in_stock_days", "distinct_days"),
                "turnover": turnover("total_sold", "sale_days"),
                "price_change_abs": absolute,
                "price_change_pct": percent,
            }
        )
        .select(*_names(MONTHLY))
    )


def price_days(daily: DataFrame, min_days: int | None = None) -> DataFrame:
    """Days at each price per item, warehouse and month; optionally only prices kept long enough."""
    counted = (
        require(daily, [*MONTH_KEYS, "price"])
        .groupBy(*MONTH_KEYS, "price")
        .agg(F.count("dt").alias("days_at_price"))
    )
    return counted if min_days is None else counted.filter(F.col("days_at_price") >= min_days)


def price_days_join(daily: DataFrame, min_days: int | None = None) -> DataFrame:
    """Daily prices, each with the months in which its series had that price.

    The months stay in one array per row, at most one entry per calendar month; explode it
    for a row per month.
    """
    keys = [*ITEM_KEYS, "price"]
    month = F.date_format(month_start("year", "month"), "yyyy-MM")
    months = (
        price_days(daily, min_days)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set(month)).alias("months"))
    )
    return daily.select(*ITEM_KEYS, "dt", "price").join(months, keys, "inner").select(
        *ITEM_KEYS, "dt", "price", "months"
    )


def item_totals(monthly: DataFrame, keys: Sequence[str] = tuple(ITEM_KEYS)) -> DataFrame:
    """Totals over all months; the mean price is the plain mean of the monthly means."""
    days = F.sum("sale_days")
    months = require(monthly, keys).withColumn("_month", F.col("year") * 12 + F.col("month"))
    return (
        group_hashed(months, keys)
        .agg(
            earliest("item_name", "_month"),
            earliest("manufacturer", "_month"),
            _total("total_sold").alias("total_sold"),
            _total("total_restocked").alias("total_restocked"),
            F.when(days == 0, F.lit(1).cast("bigint")).otherwise(days).alias("sale_days"),
            F.avg("avg_price").alias("avg_price"),
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
            earliest("open_price", "_month"),
            latest("close_price", "_month"),
            F.sum("in_stock_days").alias("in_stock_days"),
        )
        .withColumn("turnover", F.col("total_sold") / F.col("sale_days"))
        .select(*_names(TOTALS))
    )
