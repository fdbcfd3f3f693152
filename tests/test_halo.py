"""Windows per segment with a halo equal windows over whole series."""

from __future__ import annotations

import pytest
from pyspark.sql import Window, functions as F

from conftest import SMALL_SF_DIR, rows
from stockflow import fixtures as fx, queries
from stockflow.functions.dates import with_year_month
from stockflow.operators import daily, flows, halo, monthly
from stockflow.operators.halo import IS_HALO, drop_halo, segment_window, with_halo
from stockflow.operators.spikes import find_spikes

KEYS, MONTH = ["item_code", "warehouse"], ["year", "month"]


@pytest.fixture(scope="module")
def sparse(spark):
    """Series with dense months, single rows, empty months and missing values."""
    picked = F.xxhash64("item", "step")
    stamp = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("step") * 100_000).cast("timestamp_ntz")
    return with_year_month(
        spark.range(40)
        .select((F.col("id") % 8).alias("item"), F.explode(F.sequence(F.lit(0), F.lit(900))).alias("step"))
        .dropDuplicates(["item", "step"])
        .filter((F.pmod(picked, F.lit(7)) < F.col("item")) | (F.col("item") == 7))
        .filter(F.pmod(picked, F.lit(60) - F.col("item") * 8) == 0)
        .select(
            F.concat(F.lit("i"), "item").alias("item_code"),
            F.lit("w").alias("warehouse"),
            stamp.alias("dt"),
            F.when(F.pmod(picked, F.lit(11)) > 0, F.pmod(picked, F.lit(50)).cast("double")).alias("stock"),
        )
    )


@pytest.mark.parametrize("lookback", [1, 3, 7])
@pytest.mark.parametrize("partitions", ["8", "64"])
def test_halo_windows_equal_whole_windows(spark, sparse, lookback, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        whole = Window.partitionBy(*KEYS).orderBy("dt")
        part = segment_window(KEYS, MONTH, ["dt"])
        halo = with_halo(sparse, KEYS, MONTH, ["dt"], lookback, place=["item_code", *MONTH])

        def windowed(df, window):
            recent = window.rowsBetween(-lookback, 0)
            return df.withColumns(
                {
                    "previous": F.lag("stock", lookback).over(window),
                    "mean": F.avg("stock").over(recent),
                    "n": F.count(F.lit(1)).over(recent),
                }
            )

        columns = ["item_code", "dt", "stock", "previous", "mean", "n"]
        expected = rows(windowed(sparse, whole), *columns)
        assert rows(drop_halo(windowed(halo, part)), *columns) == expected
        assert len(expected) > 300
        assert halo.filter(IS_HALO).count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("shares", [1, 4, 300])
def test_flows_equal_plain_differences(spark, monkeypatch, shares):
    """With no item too frequent, the same for some, and all items cut into slices."""
    monkeypatch.setattr(halo, "SHARES", shares)
    days = daily.daily_snapshot(fx.snap(spark, SMALL_SF_DIR), fx.ORDER).cache()
    assert bool(halo.frequent(days, "item_code")) == (shares == 300)
    window = Window.partitionBy(*KEYS).orderBy("dt")
    plain = days.withColumn(
        "stock_diff", F.coalesce(F.col("stock") - F.lag("stock").over(window), F.lit(0.0))
    )
    columns = ["item_code", "warehouse", "dt", "stock_diff"]
    split = flows.with_flows(days).select(*columns)
    assert split.exceptAll(plain.select(*columns)).count() == 0
    assert split.count() == plain.count()
    days.unpersist()


def test_slices_follow_time_in_any_zone(spark):
    """Hours that a clock change skips or repeats do not turn the slices of a series around."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        times = spark.range(400).select(
            F.lit("x").alias("k"), (F.lit("2024-03-30 20:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * 10)).alias("dt")
        )
        cut = halo.with_slices(times, "k", "dt", {"x": 32}, times).orderBy("dt")
        found = [r[halo.SLICE] for r in cut.collect()]
        assert found == sorted(found) and len(set(found)) == 32
        zoned = times.withColumn("dt", F.timestamp_seconds(F.lit(1_729_980_000) + F.monotonically_increasing_id() % 1000))
        assert halo.with_slices(zoned, "k", "dt", {"x": 32}, zoned).where(F.col(halo.SLICE).isNull()).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_frequent_items_of_the_queries_are_found_without_parts(spark, monkeypatch):
    """The pass that counts items reads order lines alone, and counts what the snapshots hold."""
    seen = []
    monkeypatch.setattr(flows, "frequent", lambda df, column: seen.append(df) or {})
    queries.QUERIES["with_flows"](spark, SMALL_SF_DIR)
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    snap = fx.snap(spark, SMALL_SF_DIR).select("dt", "item_code")
    assert seen[0].exceptAll(snap).isEmpty() and snap.exceptAll(seen[0]).isEmpty()


def test_sorts_along_the_month_chain_are_led_by_a_hash(spark):
    """Texts that begin alike are seldom compared."""
    keyed = spark.createDataFrame([], "item_code string, warehouse string, dt timestamp_ntz, stock double, price double, item_name string, manufacturer string")
    months = monthly.monthly_summary(flows.net_of_transfers(flows.with_flows(keyed)))
    plan = find_spikes(months)._jdf.queryExecution().sparkPlan().toString()
    specs = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    assert len(specs) == 3 and all("windowspecdefinition(_w" in s or "windowspecdefinition(xxhash64" in s for s in specs)
