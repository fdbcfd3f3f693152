"""The monthly fact kept up to date: a load computes and writes the months from its first one on, no earlier ones.

Three tables lie below a folder: ``daily`` and ``monthly``, with a partition for each month, and ``last``, the last
row of each series as of a month. A month's flows need nothing from before it but that row, its seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import with_year_month
from ..operators.daily import daily_snapshot
from ..operators.flows import net_of_transfers, with_flows
from ..operators.monthly import monthly_summary
from ..operators.tables import clean_snapshots
from ..schema import ITEM_KEYS, LOAD_ORDER, MONTHLY
from ..sources.tables import read_table_or_empty, write_partitions

DAILY = (
    "item_code string, warehouse string, dt timestamp_ntz, stock double, price double, item_name string, "
    "manufacturer string, year int, month int"
)
SEEDS = "item_code string, warehouse string, dt timestamp_ntz, stock double, as_of int"
_SEED = "_seed"


def _number() -> Column:
    """Months counted from year 0."""
    return F.col("year") * 12 + F.col("month") - 1


def _last_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row of each series; times and stocks have a fixed width, so it is a hash aggregate."""
    return rows.groupBy(*ITEM_KEYS, *keys).agg(F.max_by("stock", "dt").alias("stock"), F.max("dt").alias("dt"))


def seeds_before(spark: SparkSession, path: str, month: int) -> DataFrame:
    """The last row of each series before a month: as stored for the month before the load, else from the daily table."""
    daily = read_table_or_empty(spark, f"{path}/daily", DAILY).where(_number() < month)
    newest = daily.agg(F.max(_number())).first()[0]
    stored = read_table_or_empty(spark, f"{path}/last", SEEDS).where(F.col("as_of") == F.lit(newest).cast("int"))
    found = _last_rows(daily) if newest is None or stored.isEmpty() else stored
    return found.select(*ITEM_KEYS, "dt", "stock")


def update_months(snapshots: DataFrame, path: str, order: Sequence[str] = LOAD_ORDER) -> None:
    """Load the snapshots of some months, each with all its rows, and bring the tables below ``path`` up to date.

    The daily rows of these months are replaced. The monthly fact is computed anew from the first of them on, as a
    changed month changes the flows of the months after it, and only these months are written; a load of the newest
    month thus costs that month and one row a series. The result equals that of all snapshots loaded at once. A load
    that broke off may be repeated; without rows nothing changes.
    """
    spark = snapshots.sparkSession
    cleaned = clean_snapshots(snapshots)
    begin = with_year_month(cleaned.agg(F.min("dt").alias("dt"))).select(_number()).first()[0]
    if begin is None:
        return
    write_partitions(with_year_month(daily_snapshot(cleaned, order)), f"{path}/daily")
    rows = read_table_or_empty(spark, f"{path}/daily", DAILY).where(_number() >= begin)
    seeds = seeds_before(spark, path, begin)

    days = rows.drop("year", "month").withColumn(_SEED, F.lit(False))
    seeded = days.unionByName(seeds.withColumn(_SEED, F.lit(True)), allowMissingColumns=True)
    flows = with_flows(seeded, measured=rows).where(~F.col(_SEED)).drop(_SEED)
    write_partitions(monthly_summary(net_of_transfers(flows)), f"{path}/monthly")
    _keep_last_rows(spark, path, rows, seeds, begin)


def _keep_last_rows(spark: SparkSession, path: str, rows: DataFrame, seeds: DataFrame, begin: int) -> None:
    """Store the last rows as of the newest month, and anew those stored for months that changed."""
    newest = rows.agg(F.max(_number())).first()[0]
    stored = read_table_or_empty(spark, f"{path}/last", SEEDS).where(F.col("as_of") >= begin)
    for month in sorted({newest, *(r.as_of for r in stored.select("as_of").distinct().collect())}):
        known = seeds.unionByName(rows.where(_number() <= month).select(*ITEM_KEYS, "dt", "stock"))
        _last_rows(known).write.mode("overwrite").parquet(f"{path}/last/as_of={month}")


def monthly_fact(spark: SparkSession, path: str) -> DataFrame:
    """The monthly fact below a folder; empty before the first load."""
    return read_table_or_empty(spark, f"{path}/monthly", MONTHLY)
