"""Properties that hold on generated data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from stockflow import fixtures as fx
from stockflow.operators import daily, flows, monthly, spikes


@pytest.fixture(scope="module")
def moved(spark):
    return flows.with_flows(daily.daily_snapshot(fx.snap(spark, SF_DIR), fx.ORDER)).cache()


@pytest.fixture(scope="module")
def facts(moved):
    return monthly.monthly_summary(flows.net_of_transfers(moved)).cache()


def test_flows_balance_where_stock_is_known(spark):
    known = fx.snap(spark, SF_DIR).filter("stock is not null")
    series = flows.with_flows(daily.daily_snapshot(known, fx.ORDER)).groupBy("item_code", "warehouse").agg(
        (
            F.sum("sold") - F.sum("restocked") + F.max_by("stock", "dt") - F.min_by("stock", "dt")
        ).alias("rest")
    )
    assert series.filter("rest <> 0").count() == 0


def test_a_row_is_sold_or_restocked(moved):
    assert moved.filter("sold * restocked <> 0 or sold < 0 or restocked < 0").count() == 0


def test_both_sides_of_a_transfer_are_zero(moved):
    transfers = flows.detect_transfers(moved)
    net = flows.net_of_transfers(moved)
    for side in ("from_warehouse", "to_warehouse"):
        touched = net.join(
            transfers.withColumnRenamed(side, "warehouse"), ["item_code", "warehouse", "dt"], "left_semi"
        )
        assert touched.count() > 0
        assert touched.filter("sold <> 0 or restocked <> 0").count() == 0


def test_first_month_is_no_spike(facts):
    found = spikes.find_spikes(facts)
    first = found.groupBy("item_code", "warehouse").agg(F.min_by("is_spike", "month_start").alias("spike"))
    assert first.filter("spike").count() == 0
    assert found.filter("trailing_avg is null and is_spike").count() == 0


def test_totals_keep_the_sums(facts):
    totals = monthly.item_totals(facts)
    columns = [F.sum("total_sold"), F.sum("total_restocked"), F.sum("in_stock_days")]
    assert totals.agg(*columns).first() == facts.agg(*columns).first()
