"""Series of single items and of whole selections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from ..functions.dates import day
from ..functions.numbers import classify_day, exceeds, price_differs, sold_restocked
from .filters import in_warehouses, options, select_items, without_anomalies
from .halo import drop_halo, segment_window, step, with_halo
from .ranking import tail_by_date
from .tables import require

LINE_COLUMNS = [
    "dt", "warehouse", "item_key", "canonical_name", "stock",
    "sold", "restocked", "price", "price_changed", "is_anomaly",
]
SERIES_COLUMNS = [
    "dt", "warehouse", "item_key", "canonical_name", "stock", "price", "sold", "restocked",
    "trailing_avg", "is_spike", "price_changed", "day_class", "emphasis",
]
SPIKE_MEASURES = ["total_sold", "avg_price", "price_change_pct"]


def _chosen(daily, item, name, require_any=False):
    return select_items(
        daily, item=item, name=name,
        item_column="item_key", name_column="canonical_name", require_any=require_any,
    )


def item_line(
    daily: DataFrame,
    item: str | None = None,
    name: str | None = None,
    warehouses: Iterable[str] | str | None = None,
) -> DataFrame:
    """Stored daily rows of a selection in date order."""
    chosen = _chosen(in_warehouses(daily, warehouses), item, name)
    return chosen.select(*LINE_COLUMNS).orderBy("dt", "warehouse", "item_key")


def item_series(
    daily: DataFrame,
    warehouses: Iterable[str] | str | None = None,
    item: str | None = None,
    name: str | None = None,
    per_item: bool = False,
    require_any: bool = True,
    rows: int = 7,
    factor: float = 1.5,
) -> DataFrame:
    """Stock, movements, spikes and price changes of a selection, recomputed after filtering.

    One series per warehouse, in which several items of one name follow each other by date
    and key; such a series has no bound and is windowed by day with a halo, so a group holds one
    warehouse's items of one day. Without a selection there are no rows, unless ``require_any`` is
    False: then it is the whole table, in which items of a warehouse follow each other. With
    ``per_item`` each item has its own series of at most one row per calendar day.
    """
    chosen = _chosen(in_warehouses(without_anomalies(daily), warehouses), item, name, require_any)
    columns = ["dt", "warehouse", "item_key", "canonical_name", "stock", "price"]
    series = require(chosen, ["warehouse", "dt"]).select(*columns)
    if per_item:
        window = Window.partitionBy("warehouse", "item_key").orderBy("dt")
        found = _series(series, window, rows, factor)
    else:
        order = ["dt", "item_key"]
        window = segment_window(["warehouse"], ["_day"], order)
        haloed = with_halo(series.withColumn("_day", day("dt")), ["warehouse"], ["_day"], order, lookback=rows)
        found = drop_halo(_series(haloed, window, rows, factor))
    return found.select(*SERIES_COLUMNS)


def _series(df: DataFrame, window: WindowSpec, rows: int, factor: float) -> DataFrame:
    sold, restocked = sold_restocked(step("stock", window))
    label, emphasis = classify_day("is_spike", "price_changed")
    recent = F.avg("sold").over(window.rowsBetween(-(rows - 1), 0))
    return (
        df.withColumns(
            {
                "sold": sold,
                "restocked": restocked,
                "price_changed": price_differs("price", F.lag("price").over(window)),
            }
        )
        .withColumn("trailing_avg", recent)
        .withColumn("is_spike", exceeds("sold", "trailing_avg", factor))
        .withColumns({"day_class": label, "emphasis": emphasis})
    )


def drill_down(top: DataFrame, daily: DataFrame) -> DataFrame:
    """Daily rows, in any warehouse, of the items in a top table.

    The top table ends in a limit, so Spark knows its size and broadcasts it by itself. The rows meet it by item
    key alone, and the name is compared on meeting, so that a table stored by item key need not be shuffled for it.
    """
    picks = top.groupBy(F.col("item_code").alias("_item")).agg(F.collect_set("item_name").alias("_names"))
    same = (F.col("item_key") == F.col("_item")) & F.array_contains("_names", F.col("canonical_name"))
    return daily.join(picks, same, "left_semi")


def spike_series(
    spikes: DataFrame,
    warehouse: str | None = None,
    item: str | None = None,
    name: str | None = None,
    n: int | None = None,
    only_spikes: bool = False,
) -> DataFrame:
    """The months of a selection in long form, one row per measure; with ``n`` only the latest months."""
    chosen = select_items(spikes, warehouse, item, name)
    if only_spikes:
        chosen = chosen.filter("is_spike")
    if n is not None:
        chosen = tail_by_date(chosen, n)
    return require(chosen, ["warehouse"]).unpivot(
        ["month_start", "warehouse", "item_code", "item_name"], SPIKE_MEASURES, "metric", "value"
    )


def name_options(
    spikes: DataFrame, warehouse: str | None = None, item: str | None = None
) -> DataFrame:
    """Names to choose from, given a warehouse or an item; none without either."""
    if not warehouse and not item:
        return spikes.select("item_name").limit(0)
    return options(select_items(spikes, warehouse, item), "item_name")


def spike_turnover(spikes: DataFrame) -> DataFrame:
    """A placeholder turnover, a tenth of the units sold, for a table without one."""
    if "turnover" in spikes.columns:
        return spikes
    return spikes.withColumn("turnover", F.col("total_sold") / 10)


def export_spikes(
    spikes: DataFrame, warehouse: str | None = None, item: str | None = None, name: str | None = None
) -> DataFrame:
    """Spike rows of a selection, with a turnover."""
    return spike_turnover(select_items(spikes, warehouse, item, name))
