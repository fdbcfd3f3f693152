"""Rankings, their chart data and their exports. Ties are ordered by the full key."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import price_change_fraction, ratio, round_to, to_number
from ..schema import ITEM_KEYS
from .filters import in_warehouses
from .tables import rename, require

RANK_KEYS = ["warehouse", "item_name", "item_code"]
SELLER_KEYS = ["item_key", "canonical_name", "warehouse"]
PRICE_COLUMNS = ["avg_price", "min_price", "max_price"]
EXPORT_NAMES = {"sale_days": "times_sold", "in_stock_days": "times_in_stock"}


def _chosen(df: DataFrame, warehouses: Iterable[str] | None, every: bool) -> DataFrame:
    """Rows of the chosen warehouses, or of ``every`` one; without a choice there are none."""
    return df if every else in_warehouses(df, warehouses, empty="none")


def _top(df: DataFrame, measure: str, keys: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(measure), *keys).limit(n)


def top_fast(totals: DataFrame, n: int = 1000) -> DataFrame:
    """Items that sold, by turnover."""
    return _top(totals.filter(F.col("total_sold") > 0), "turnover", ITEM_KEYS, n)


def top_slow(totals: DataFrame, n: int = 1000) -> DataFrame:
    """Items that never sold, by days in stock."""
    return _top(totals.filter(F.col("total_sold") == 0), "in_stock_days", ITEM_KEYS, n)


def top_restocked(totals: DataFrame, n: int = 1000) -> DataFrame:
    """Items by units restocked."""
    return _top(totals, "total_restocked", ITEM_KEYS, n)


def rank_input(df: DataFrame, measure: str, fallback: str | None = None) -> DataFrame:
    """A ranking table as read back: the measure as a number, rows without a name dropped."""
    source = measure if measure in df.columns else fallback
    if source is None or source not in df.columns:
        value = F.lit(0.0)
    elif dict(df.dtypes)[source] == "string":
        value = to_number(source, default=0.0)
    else:
        value = F.coalesce(F.col(source).cast("double"), F.lit(0.0))
    return require(df.withColumn(measure, value), ["item_name"])


def rank_base(df: DataFrame, measure: str) -> DataFrame:
    """Measure summed by warehouse, name and code."""
    return (
        require(df, RANK_KEYS)
        .groupBy(*RANK_KEYS)
        .agg(F.coalesce(F.sum(measure), F.lit(0.0)).alias(measure))
    )


def rank_fast(
    df: DataFrame, warehouses: Iterable[str] | None = None, n: int = 100, every: bool = False
) -> DataFrame:
    """Best sellers over all chosen warehouses together."""
    base = rank_base(rank_input(df, "total_sold"), "total_sold")
    return _top(_chosen(base, warehouses, every), "total_sold", RANK_KEYS, n)


def rank_restock(
    df: DataFrame, warehouses: Iterable[str] | None = None, n: int = 100, every: bool = False
) -> DataFrame:
    """Most restocked items over all chosen warehouses together."""
    base = rank_base(rank_input(df, "total_restocked", "total_sold"), "total_restocked")
    return _top(_chosen(base, warehouses, every), "total_restocked", RANK_KEYS, n)


def top_sellers(daily: DataFrame, warehouses: Iterable[str] | None = None, n: int = 100) -> DataFrame:
    """Best sellers of the enriched daily table, anomalies included."""
    totals = (
        require(in_warehouses(daily, warehouses), SELLER_KEYS)
        .groupBy(*SELLER_KEYS)
        .agg(F.coalesce(F.sum("sold"), F.lit(0.0)).alias("sold"))
    )
    return rename(
        _top(totals, "sold", SELLER_KEYS, n), {"item_key": "item_code", "canonical_name": "item_name"}
    )


def round_prices(df: DataFrame, columns: Sequence[str] = tuple(PRICE_COLUMNS)) -> DataFrame:
    """Price columns with two places."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: round_to(c, 2) for c in present}) if present else df


def turnover_by_avg_stock(df: DataFrame) -> DataFrame:
    """Turnover as units sold per unit of average stock, where the table has one."""
    if "avg_stock" not in df.columns:
        return df
    return df.withColumn("turnover", round_to(ratio(F.col("total_sold"), F.col("avg_stock")), 2))


def export_columns(df: DataFrame) -> DataFrame:
    """All rows in the columns of an export: rounded prices and the price change as a fraction."""
    rounded = round_prices(df)
    if {"open_price", "close_price"} <= set(df.columns):
        rounded = rounded.withColumn(
            "price_change_frac", price_change_fraction("open_price", "close_price")
        )
    return rename(turnover_by_avg_stock(rounded), EXPORT_NAMES)


def _export(
    df: DataFrame, measure: str, warehouses: Iterable[str] | None, n: int, every: bool
) -> DataFrame:
    return export_columns(_top(_chosen(df, warehouses, every), measure, ITEM_KEYS, n))


def export_top_fast(
    df: DataFrame, warehouses: Iterable[str] | None = None, n: int = 100, every: bool = False
) -> DataFrame:
    """Best sellers with rounded prices and the price change as a fraction."""
    return _export(rank_input(df, "total_sold"), "total_sold", warehouses, n, every)


def export_top_restock(
    df: DataFrame, warehouses: Iterable[str] | None = None, n: int = 100, every: bool = False
) -> DataFrame:
    """Most restocked items with rounded prices and the price change as a fraction."""
    return _export(rank_input(df, "total_restocked", "total_sold"), "total_restocked", warehouses, n, every)


def tail_by_date(
    df: DataFrame, n: int = 200, date: str = "month_start", keys: Sequence[str] = tuple(ITEM_KEYS)
) -> DataFrame:
    """The latest rows by date, in ascending order."""
    latest = df.orderBy(F.desc_nulls_last(date), *[F.desc(k) for k in keys]).limit(n)
    return latest.orderBy(date, *keys)
