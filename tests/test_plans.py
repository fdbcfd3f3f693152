"""Physical plans keep the properties the design counts on."""

from __future__ import annotations

import re

from conftest import SF_DIR, SMALL_SF_DIR
from stockflow import fixtures as fx
from stockflow.operators import daily, filters, flows, monthly, ranking
from stockflow.queries import QUERIES


def _plan(df, run: bool = False) -> str:
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _formatted(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted"
    )


def test_month_chain_reads_and_deduplicates_once(spark):
    """With no item too frequent: deduplication, placement by item, and nothing more up to the totals."""
    for name in ("monthly_summary", "item_totals", "net_of_transfers"):
        plan = _plan(QUERIES[name](spark, SMALL_SF_DIR), run=True)
        assert plan.count("FileScan parquet [l_") == 1
        assert len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange hashpartitioning", plan)) == 2, name


def test_month_chain_with_frequent_items_reads_once(spark):
    plan = _plan(QUERIES["monthly_summary"](spark, SF_DIR), run=True)
    assert plan.count("FileScan parquet [l_") == 1 and "ReusedExchange" in plan


def test_numbers_by_load_rank_need_no_sort(spark):
    assert "Sort" not in _plan(QUERIES["daily_rollup"](spark, SF_DIR), run=True)


def test_stored_items_are_looked_up_in_their_bucket(spark):
    """The number of buckets is shown only by a scan that keeps them apart; other scans skip the same files."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = _formatted(QUERIES["stored_item_line"](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert re.search(r"SelectedBucketsCount: 1 out of 16", plan)
    assert re.search(r"PushedFilters: \[.*EqualTo\(item_key,it-000007", plan)


def test_stored_items_are_joined_where_they_lie(spark):
    """Also where the picks are too many to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(QUERIES["stored_drill_down"](spark, SF_DIR), run=True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = plan[: plan.index("Bucketed: true")].rindex("SortMergeJoin")
    assert "Exchange" not in plan[stored : plan.index("Bucketed: true")] and "LeftSemi" in plan[stored:]


def test_filters_on_keys_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "snap")
    fx.snap(spark, SF_DIR).write.parquet(path)
    days = daily.daily_snapshot(spark.read.parquet(path), fx.ORDER)
    plan = _formatted(filters.select_items(flows.with_flows(days), warehouse="WH-A", item="it-000007"))
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", plan)
    assert pushed and all("EqualTo(warehouse,WH-A)" in p for p in pushed)


def test_only_needed_columns_are_read(spark):
    plan = _formatted(daily.daily_rollup(fx.snap(spark, SF_DIR), fx.ORDER))
    read = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert any("l_quantity" in r and "l_linestatus" not in r for r in read)
    assert "p_partkey:bigint" in read


def test_rankings_keep_only_their_rows(spark):
    totals = monthly.item_totals(QUERIES["monthly_summary"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in _plan(ranking.top_fast(totals))


def test_no_python_and_no_cross_joins(spark):
    for name in ("monthly_summary", "enrich_daily", "item_series", "detect_transfers", "identity_conflicts"):
        plan = _plan(QUERIES[name](spark, SF_DIR))
        assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan), name


def test_enriching_reads_the_snapshots_once(spark):
    assert _plan(QUERIES["enrich_daily"](spark, SF_DIR), run=True).count("FileScan parquet [l_") == 1


def test_only_marked_rows_are_joined_as_transfers(spark):
    logical = flows.transfers_of(
        flows.marked_transfers(flows.with_flows(daily.daily_snapshot(fx.snap(spark, SF_DIR), fx.ORDER)))
    )
    plan = logical._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert len(re.findall(r"Filter .*_we\d", plan[join:])) >= 2


def test_flows_of_transfers_are_computed_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(QUERIES["detect_transfers"](spark, SMALL_SF_DIR), run=True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One window for the differences and one for the marks; the other side of the join reads their exchange.
    assert len(re.findall(r"\bWindow \[", plan)) == 2 and "ReusedExchange" in plan


def test_inputs_grow_with_the_data(spark):
    sizes = {}
    for folder in (SF_DIR, SMALL_SF_DIR):
        snap = fx.snap(spark, folder)
        sizes[folder] = [snap.select(c).distinct().count() for c in ("item_code", "warehouse")]
    assert sizes[SMALL_SF_DIR][0] > 5 * sizes[SF_DIR][0]
    assert sizes[SMALL_SF_DIR][1] > sizes[SF_DIR][1]
    assert QUERIES["top_slow"](spark, SF_DIR).count() > 0
    assert QUERIES["detect_transfers"](spark, SF_DIR).count() > 0
