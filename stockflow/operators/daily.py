"""From snapshot rows to one row per item, warehouse and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from ..functions.dates import day
from ..schema import DAY_KEYS, DAILY_DEFAULTS, LOAD_ORDER
from .tables import conform, require

_RANK = "_rank"
HASH = "_hash"


def rank_of(*order: str) -> Column:
    """Load order as one comparable value."""
    return (F.struct(*order) if len(order) > 1 else F.col(order[0])).alias(_RANK)


def group_hashed(df: DataFrame, keys: Sequence[str]) -> GroupedData:
    """Group by the keys, led by their hash.

    Aggregates that keep texts sort their rows. Sorting by a number first settles nearly every
    comparison without touching the texts of the keys.
    """
    return df.groupBy(F.xxhash64(*keys).alias(HASH), *keys)


def earliest(column: str, rank: str = _RANK) -> Column:
    """First present value of a column by rank; a row without a value has no rank."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(rank))).alias(column)


def latest(column: str, rank: str = _RANK) -> Column:
    """Last present value of a column by rank."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(rank))).alias(column)


def daily_snapshot(
    df: DataFrame, order: Sequence[str] = LOAD_ORDER, with_sum: bool = False
) -> DataFrame:
    """One row per item, warehouse and time: each column's first present value in load order.

    ``with_sum`` adds the summed stock, from which ``rollup_of`` takes the daily file without
    another pass over the snapshots.
    """
    values = ["stock", "price", "item_name", "manufacturer"]
    total = [_sum_of_stock().alias("stock_sum")] if with_sum else []
    rows = require(df, DAY_KEYS).select(*DAY_KEYS, *values, rank_of(*order))
    return (
        group_hashed(rows, DAY_KEYS).agg(*[earliest(c) for c in values], *total).drop(HASH)
    )


def _sum_of_stock() -> Column:
    return F.coalesce(F.sum("stock"), F.lit(0.0))


def rollup_of(daily: DataFrame) -> DataFrame:
    """The daily file of a daily frame that carries its summed stock."""
    return daily.select(
        "dt",
        "item_code",
        "warehouse",
        F.col("stock_sum").alias("total_sold"),
        F.col("price").alias("day_open_price"),
    )


def daily_rollup(df: DataFrame, order: Sequence[str] = LOAD_ORDER) -> DataFrame:
    """Daily file: summed stock, reported as units sold, and the first price of the day."""
    missing = [c for c in ("dt", "stock", "price") if c not in df.columns]
    if missing:
        raise ValueError(f"daily rollup needs the columns {missing}")
    keys = ["dt", "item_code", "warehouse"]
    rows = require(df, keys).select(*keys, "stock", "price", rank_of(*order))
    return (
        group_hashed(rows, keys)
        .agg(_sum_of_stock().alias("total_sold"), earliest("price").alias("day_open_price"))
        .drop(HASH)
    )


def daily_by_day(
    df: DataFrame, order: Sequence[str] = LOAD_ORDER, extra: Sequence[str] = ()
) -> DataFrame:
    """One row per warehouse, item key and calendar day: each column's first present value in time.

    ``n_rows`` is the number of snapshot rows of the day.
    """
    keys = ["warehouse", "item_key", "dt"]
    values = [c for c in DAILY_DEFAULTS if c not in keys] + list(extra)
    rows = require(conform(df, DAILY_DEFAULTS), keys).select(
        "warehouse", "item_key", day("dt").alias("dt"), *values, rank_of("dt", *order)
    )
    count = F.count(F.lit(1)).alias("n_rows")
    return group_hashed(rows, keys).agg(*[earliest(c) for c in values], count).drop(HASH)
