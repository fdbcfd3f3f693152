"""The month analysis and the spike analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.daily import daily_snapshot, rollup_of
from ..operators.flows import marked_transfers, net_of_transfers, transfers_of, with_flows
from ..operators.identity import identity_conflicts
from ..operators.monthly import item_totals, monthly_summary
from ..operators.ranking import top_fast, top_restocked, top_slow
from ..operators.spikes import find_spikes
from ..operators.tables import clean_snapshots
from ..schema import LOAD_ORDER
from ..sources.tables import stage, write_csv, write_table
from ..sources.workbooks import load_snapshots, with_load_rank


def run_month_analysis(
    snapshots: DataFrame,
    order: Sequence[str] = LOAD_ORDER,
    staged: bool = False,
    folder: str | None = None,
    top: int = 1000,
) -> dict[str, DataFrame]:
    """Every table of the month analysis.

    The plans stay lazy from end to end. With ``staged``, the net daily flows, the monthly fact and
    the totals are written once, below ``folder`` or the shared folder, since several tables are
    read from each. Netting comes before the writing because it shares the placement of the flows.
    Snapshots are read twice: for the daily flows and for the identity check. ``top`` only cuts the
    three top tables; nothing else is read from them.
    """

    def keep(df: DataFrame, name: str) -> DataFrame:
        return stage(df, name, folder) if staged else df

    cleaned = clean_snapshots(snapshots)
    daily = daily_snapshot(cleaned, order, with_sum=True)
    marked = keep(marked_transfers(with_flows(daily, measured=cleaned)), "net_flows")
    net = net_of_transfers(marked)
    monthly = keep(monthly_summary(net), "monthly")
    totals = keep(item_totals(monthly), "totals")
    return {
        "monthly": monthly,
        "transfers": transfers_of(marked),
        "identity_conflicts": identity_conflicts(cleaned),
        "item_totals": totals,
        "top_fast": top_fast(totals, top),
        "top_slow": top_slow(totals, top),
        "top_restocked": top_restocked(totals, top),
        "daily_rollup": rollup_of(net),
    }


def run_from_folders(
    spark: SparkSession, folders: Mapping[str, str], folder: str | None = None
) -> dict[str, DataFrame]:
    """The month analysis of workbook folders, one per warehouse, each workbook decoded once."""
    snapshots = with_load_rank(stage(load_snapshots(spark, folders), "snapshots", folder))
    return run_month_analysis(snapshots, ["load_rank"], staged=True, folder=folder)


def write_month_analysis(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write the tables below a folder: the monthly fact by month, the daily file as ordered CSV."""
    for name, df in tables.items():
        target = f"{path}/{name}"
        if name == "daily_rollup":
            write_csv(df, target)
        elif name == "monthly":
            write_table(df, target, partition_by=["year", "month"])
        elif name.startswith("top_"):
            write_table(df.coalesce(1), target)
        else:
            write_table(df, target)


def run_spike_analysis(
    monthly: DataFrame, window: int = 3, factor: float = 1.5, path: str | None = None
) -> DataFrame:
    """The spike table of a monthly fact, written to ``path`` if one is given."""
    spikes = find_spikes(monthly, window, factor)
    if path is not None:
        write_table(spikes, path)
    return spikes
