"""Stock movements and transfers between warehouses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.dates import with_year_month
from ..functions.numbers import sold_restocked
from ..schema import ITEM_KEYS
from .halo import SLICE, drop_halo, frequent, hashed, placed, segment_window, step, with_halo, with_slices

_SPOT = "_spot"
#: Whether a moving row has a partner of the opposite sign, that is, takes part in a transfer.
MARK = "is_transfer"


def with_flows(daily: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Add the stock difference to the previous row of the series, split into sold and restocked.

    Rows end up placed by item, which the netting, the monthly summary and the totals reuse. The rows of an item
    that holds too many for one task are placed by warehouse and slice of time instead, each slice with the row
    before it; what follows then shuffles them by its own keys. Items are counted once, in ``measured``, a frame
    that is cheaper to read and has an item's rows in about the same proportion, or else in the daily rows.
    """
    measured = daily if measured is None else measured
    hot = frequent(measured, "item_code")
    rows = with_year_month(daily)
    if hot:
        spot = F.when(F.col(SLICE).isNotNull(), F.col("warehouse"))
        rows = with_slices(rows, "item_code", "dt", hot, measured).withColumn(_SPOT, spot)
        segment = [SLICE, _SPOT]
        rows = with_halo(rows, ITEM_KEYS, segment, ["dt"], place=["item_code", *segment], several=F.col(SLICE).isNotNull())
        moved = drop_halo(rows.withColumn("stock_diff", _change(segment_window(ITEM_KEYS, segment, ["dt"])))).drop(*segment)
    else:
        moved = placed(rows, "item_code").withColumn("stock_diff", _change(segment_window(ITEM_KEYS, [], ["dt"])))
    sold, restocked = sold_restocked("stock_diff")
    return moved.withColumns({"sold": sold, "restocked": restocked})


def _change(series: WindowSpec) -> Column:
    return F.coalesce(step("stock", series), F.lit(0.0))


def inflows(flows: DataFrame) -> DataFrame:
    """Rows where stock rose, as arrivals."""
    return flows.filter(F.col("stock_diff") > 0).select(
        "dt", "item_code", F.col("warehouse").alias("to_warehouse"), F.col("stock_diff").alias("qty")
    )


def outflows(flows: DataFrame) -> DataFrame:
    """Rows where stock fell, as departures with a positive quantity."""
    return flows.filter(F.col("stock_diff") < 0).select(
        "dt", "item_code", F.col("warehouse").alias("from_warehouse"), (-F.col("stock_diff")).alias("qty")
    )


def marked_transfers(flows: DataFrame) -> DataFrame:
    """Flows with a mark on the rows of transfers.

    A group holds one row per warehouse. Rows without movement need no partner, so they are
    spread by warehouse and form no large group.
    """
    diff = F.col("stock_diff")
    group = Window.partitionBy(*hashed("item_code", "dt", F.abs(diff), F.when(diff == 0, F.col("warehouse"))))
    both = F.max(diff > 0).over(group) & F.max(diff < 0).over(group)
    return flows.withColumn(MARK, F.coalesce(both, F.lit(False)))


def transfers_of(marked: DataFrame) -> DataFrame:
    """Arrivals and departures of the same item, time and quantity in different warehouses.

    Only marked rows are joined. Many to many: every matching pair is a transfer. Both sides are the same rows, so
    they are computed and shuffled once; which of a pair arrives is a condition on both, as one on either side would
    part them again.
    """
    moved = marked.filter(MARK).select("dt", "item_code", F.abs("stock_diff").alias("qty"), "warehouse", "stock_diff")
    sides = [moved.withColumnsRenamed({"warehouse": f"{s}_warehouse", "stock_diff": f"_{s}"}) for s in ("to", "from")]
    return (
        sides[0]
        .join(sides[1], ["dt", "item_code", "qty"], "inner")
        .filter((F.col("_to") > F.col("_from")) & (F.col("from_warehouse") != F.col("to_warehouse")))
        .select("dt", "item_code", "from_warehouse", "to_warehouse", "qty")
    )


def detect_transfers(flows: DataFrame) -> DataFrame:
    """The transfers among flows that are not marked yet."""
    return transfers_of(marked_transfers(flows))


def net_of_transfers(flows: DataFrame) -> DataFrame:
    """Flows in which both sides of every transfer count as neither sold nor restocked.

    Flows without a mark are marked first.
    """
    marked = flows if MARK in flows.columns else marked_transfers(flows)
    zero = F.lit(0.0)
    return marked.withColumns(
        {c: F.when(F.col(MARK), zero).otherwise(F.col(c)) for c in ("sold", "restocked")}
    ).drop(MARK)
