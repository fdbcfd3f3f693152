"""The enriched daily table behind item series and top sellers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import price_differs, sold_restocked
from ..functions.text import item_key
from ..schema import LOAD_ORDER, NAME_DEFAULTS
from .daily import daily_by_day
from .halo import step
from .identity import NAME_KEYS, name_table
from .tables import conform

SERIES_KEYS = ["warehouse", "item_key"]
ENRICHED = [
    "warehouse", "item_key", "dt", "stock", "price", "item_name", "canonical_name",
    "sold", "restocked", "price_changed", "is_anomaly",
]


def with_item_key(df: DataFrame) -> DataFrame:
    """Add the item key; absent code, name or warehouse columns are empty."""
    return conform(df, NAME_DEFAULTS).withColumn("item_key", item_key("item_code", "item_name"))


def _metrics(daily: DataFrame) -> DataFrame:
    """Flows and flags along each series, which has at most one row per calendar day."""
    window = Window.partitionBy(*SERIES_KEYS).orderBy("dt")
    sold, restocked = sold_restocked("_diff")
    moves = (F.col("sold") > 0) | (F.col("restocked") > 0)
    return (
        daily.withColumns(
            {
                "_diff": F.coalesce(step("stock", window), F.lit(0.0)),
                "price_changed": price_differs("price", F.lag("price").over(window)),
            }
        )
        .withColumns({"sold": sold, "restocked": restocked})
        .withColumn("is_anomaly", moves & (F.col("_diff") == 0))
    )


def daily_metrics(df: DataFrame, order: Sequence[str] = LOAD_ORDER) -> DataFrame:
    """Daily rows per item key with sold, restocked, price change and anomaly flag.

    A row is anomalous when stock moved and did not change; flows taken from one difference
    never are.
    """
    return _metrics(daily_by_day(df, order)).select(*ENRICHED)


def enrich_daily(
    df: DataFrame, order: Sequence[str] = LOAD_ORDER, key: Sequence[str] = NAME_KEYS
) -> DataFrame:
    """Daily metrics with canonical names.

    A daily row has one name, since the item key holds it, and knows how many snapshot rows it stands
    for; names are counted and joined on these rows, and snapshots read once.
    """
    keyed = with_item_key(df)
    daily = daily_by_day(keyed, order, extra=[c for c in key if c not in SERIES_KEYS])
    if set(key) == set(NAME_KEYS):  # the key holds the name, so there is none to choose
        named = daily.withColumn("canonical_name", F.coalesce("item_name", F.lit("")))
    else:
        names = name_table(daily, key, rows="n_rows")
        named = daily.drop("canonical_name").join(names, list(key), "left")
    return _metrics(named).select(*ENRICHED)
