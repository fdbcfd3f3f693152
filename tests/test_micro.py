"""Small cases with answers worked out by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from conftest import day, rows
from stockflow.operators import daily, enrich, flows, identity, monthly, ranking, series, spikes

INF = math.inf


def test_daily_takes_first_present_value_of_each_column(days):
    found = {(r.dt, r.item_code, r.warehouse): (r.stock, r.price) for r in days.collect()}
    assert len(found) == 12
    assert found[day("2025-01-30"), "A1", "W1"] == (10, 100)
    assert found[day("2025-01-30"), "B2", "W1"] == (4, 20)
    assert found[day("2025-01-31"), "B2", "W1"] == (None, 20)
    assert found[day("2025-02-02"), "A1", "W1"] == (12, None)


def test_differences_ignore_gaps_and_cross_months(movements):
    found = rows(movements, "item_code", "warehouse", "dt", "stock_diff")
    assert [r[3] for r in found] == [0, -3, 0, 5, 0, 3, -2, 0, 0, 0, 0, 0]
    signs = rows(movements.filter("sold = 0"), "sold")
    assert not any(math.copysign(1, r[0]) < 0 for r in signs)


def test_transfers_and_netting(movements):
    found = flows.detect_transfers(movements)
    assert rows(found, *found.columns) == [(day("2025-01-31"), "A1", "W1", "W2", 3.0)]
    net = flows.net_of_transfers(movements).filter("sold > 0 or restocked > 0")
    assert rows(net, "item_code", "warehouse", "dt", "sold", "restocked") == [
        ("A1", "W1", day("2025-02-02"), 0, 5),
        ("A1", "W2", day("2025-02-01"), 2, 0),
    ]


def test_transfers_over_cancel(spark):
    data = [("W1", 1, 6), ("W2", 9, 4), ("W3", 9, 4)]
    frame = spark.createDataFrame(
        [(day(d), "A", w, float(s)) for w, a, b in data for d, s in (("2025-01-01", a), ("2025-01-02", b))],
        "dt timestamp_ntz, item_code string, warehouse string, stock double",
    )
    moved = flows.with_flows(frame)
    assert rows(flows.detect_transfers(moved), "from_warehouse", "to_warehouse", "qty") == [
        ("W2", "W1", 5), ("W3", "W1", 5),
    ]
    net = flows.net_of_transfers(moved)
    assert net.filter("sold > 0 or restocked > 0").count() == 0


def test_monthly_summary(months):
    columns = [
        "item_code", "warehouse", "month", "total_sold", "total_restocked", "sale_days", "avg_price",
        "in_stock_days", "last_stock", "distinct_days", "min_price", "max_price", "open_price",
        "close_price", "price_change_abs",
    ]
    assert rows(months, *columns) == [
        ("A1", "W1", 1, 0, 0, 0, 105, 2, 7, 2, 100, 110, 100, 110, 10),
        ("A1", "W1", 2, 0, 5, 0, 110, 2, 12, 2, 110, 110, 110, 110, 0),
        ("A1", "W2", 1, 0, 0, 0, 25, 2, 8, 2, 0, 50, 0, 50, 50),
        ("A1", "W2", 2, 2, 0, 1, 60, 2, 6, 2, 60, 60, 60, 60, 0),
        ("B2", "W1", 1, 0, 0, 0, 20, 1, 4, 2, 20, 20, 20, 20, 0),
        ("B2", "W1", 2, 0, 0, 0, 0, 2, 1, 2, 0, 0, 0, 0, 0),
    ]
    percent = [round(r[3], 9) for r in rows(months, "item_code", "warehouse", "month", "price_change_pct")]
    assert percent == [10, 0, INF, 0, 0, 0]


def test_monthly_parts_agree_with_the_summary(months, movements):
    keys = ["item_code", "warehouse", "year", "month"]
    parts = monthly.monthly_price_range(movements).join(monthly.monthly_open_close(movements), keys)
    columns = [*keys, "min_price", "max_price", "open_price", "close_price"]
    assert rows(parts, *columns) == rows(months, *columns)


def test_item_totals(totals):
    columns = [
        "item_code", "warehouse", "total_sold", "total_restocked", "sale_days", "avg_price",
        "min_price", "max_price", "open_price", "close_price", "in_stock_days", "turnover",
    ]
    assert rows(totals, *columns) == [
        ("A1", "W1", 0, 5, 1, 107.5, 100, 110, 100, 110, 4, 0),
        ("A1", "W2", 2, 0, 1, 42.5, 0, 60, 0, 60, 4, 2),
        ("B2", "W1", 0, 0, 1, 10, 0, 20, 20, 0, 3, 0),
    ]


def test_rankings(totals):
    def keys(df):
        return [(r.item_code, r.warehouse) for r in df.collect()]

    assert keys(ranking.top_fast(totals)) == [("A1", "W2")]
    assert keys(ranking.top_slow(totals)) == [("A1", "W1"), ("B2", "W1")]
    assert keys(ranking.top_restocked(totals)) == [("A1", "W1"), ("A1", "W2"), ("B2", "W1")]
    assert keys(ranking.top_restocked(totals, 1)) == [("A1", "W1")]


def test_chart_data_wants_a_warehouse(totals):
    assert ranking.rank_fast(totals, None).count() == 0
    assert rows(ranking.rank_fast(totals, "W2"), "warehouse", "total_sold") == [("W2", 2)]
    assert ranking.rank_restock(totals.drop("total_restocked"), ["W1", "W2"]).first().total_restocked == 2


def test_exports(totals):
    export = ranking.export_top_restock(totals, ["W1", "W2"])
    assert {"times_sold", "times_in_stock", "price_change_frac"} <= set(export.columns)
    assert [r.price_change_frac for r in export.collect()] == [0.1, INF, -1.0]
    with_stock = totals.withColumn("avg_stock", F.lit(3.0))
    assert ranking.export_top_fast(with_stock, ["W2"]).first().turnover == 0.67


def test_daily_rollup(snapshots):
    found = daily.daily_rollup(snapshots, ["seq"])
    values = {(r.dt, r.item_code, r.warehouse): (r.total_sold, r.day_open_price) for r in found.collect()}
    assert values[day("2025-01-30"), "A1", "W1"] == (109, 100)
    assert values[day("2025-01-30"), "B2", "W1"] == (44, 20)
    assert values[day("2025-01-31"), "B2", "W1"] == (0, 20)
    assert values[day("2025-02-02"), "A1", "W1"] == (12, None)
    again = daily.rollup_of(daily.daily_snapshot(snapshots, ["seq"], with_sum=True))
    assert rows(again, *found.columns) == rows(found, *found.columns)


def test_daily_rollup_names_missing_columns(snapshots):
    try:
        daily.daily_rollup(snapshots.drop("price"), ["seq"])
    except ValueError as error:
        assert "price" in str(error)
    else:
        raise AssertionError("no error")


def test_price_days(movements):
    counted = monthly.price_days(movements)
    assert rows(counted.filter("item_code = 'B2'"), "month", "price", "days_at_price") == [
        (1, 20, 2), (2, 0, 2),
    ]
    assert monthly.price_days(movements, min_days=2).count() == 3
    joined = monthly.price_days_join(movements).filter("item_code = 'A1' and warehouse = 'W1'")
    found = rows(joined, "dt", "price", "months")
    assert found[0][2] == ["2025-01"]
    assert found[1][1:] == (110, ["2025-01", "2025-02"])


def test_identity_conflicts(snapshots):
    found = identity.identity_conflicts(snapshots)
    assert rows(found, "item_name", "item_code", "item_name_norm") == [
        ("Filter", "A1", "filter"), ("Filter дефект", "A1", "filter"), ("filter ", "B2", "filter"),
    ]


def test_canonical_names(spark):
    schema = "warehouse string, item_key string, item_name string"
    names = spark.createDataFrame([("W", "k", n) for n in ["b", "a", "b", "a", None]], schema)
    found = identity.canonical_names(names)
    assert {r.canonical_name for r in found.collect()} == {"a"}
    assert rows(identity.name_variants(names), "item_name") == [("a",), ("b",)]
    assert rows(identity.variants_text(identity.name_variants(names)), "name_variants") == [("a, b",)]
    assert rows(found, "item_name", "name_changed") == [
        (None, True), ("a", False), ("a", False), ("b", True), ("b", True),
    ]
    nameless = identity.canonical_names(spark.createDataFrame([("W", "k", None)], schema)).first()
    assert (nameless.canonical_name, nameless.name_changed) == ("", True)


def _months(spark, sold):
    data = [("A", "W", 2025, i + 1, v) for i, v in enumerate(sold)]
    return spark.createDataFrame(
        data, "item_code string, warehouse string, year int, month int, total_sold double"
    )


def test_month_spikes(spark):
    found = spikes.find_spikes(_months(spark, [10.0, 12.0, 30.0, 5.0, 40.0]))
    values = rows(found, "month", "trailing_avg", "is_spike")
    assert [r[2] for r in values] == [False, False, True, False, True]
    assert [None if r[1] is None else round(r[1], 4) for r in values] == [None, 10, 11, 17.3333, 15.6667]
    gaps = spikes.find_spikes(_months(spark, [1.0, None, 3.0, 10.0, 20.0]))
    assert [r[1] for r in rows(gaps, "month", "trailing_avg")] == [None, 1, 1, 2, 6.5]


def test_item_series(spark, days):
    frame = days.withColumnsRenamed({"item_code": "item_key", "item_name": "canonical_name"})
    found = series.item_series(frame, warehouses="W1", item="A1")
    assert rows(
        found, "dt", "sold", "restocked", "trailing_avg", "is_spike", "price_changed", "day_class", "emphasis"
    ) == [
        (day("2025-01-30"), 0, 0, 0, False, False, "ordinary", 5),
        (day("2025-01-31"), 3, 0, 1.5, True, True, "spike+price change", 10),
        (day("2025-02-01"), 0, 0, 1, False, False, "ordinary", 5),
        (day("2025-02-02"), 0, 5, 0.75, False, False, "ordinary", 5),
    ]
    assert series.item_series(frame).count() == 0
    per_item = series.item_series(frame, per_item=True, require_any=False)
    alone = per_item.filter("item_key = 'A1' and warehouse = 'W1'")
    assert rows(alone, *found.columns) == rows(found, *found.columns)


def test_item_series_of_the_whole_table(days):
    frame = days.withColumnsRenamed({"item_code": "item_key", "item_name": "canonical_name"})
    found = series.item_series(frame, require_any=False)
    assert rows(found, "warehouse", "dt", "item_key") == rows(frame, "warehouse", "dt", "item_key")
    assert rows(found.filter("warehouse = 'W2'"), *found.columns) == rows(
        series.item_series(frame, warehouses="W2", item="A1"), *found.columns
    )


def test_items_of_one_name_share_a_series(spark):
    data = [
        (day(d), "W", k, "n", float(s), 1.0)
        for d, k, s in [
            ("2025-01-31", "x", 9), ("2025-01-31", "y", 4), ("2025-02-01", "x", 8), ("2025-02-01", "y", 5),
        ]
    ]
    frame = spark.createDataFrame(
        data,
        "dt timestamp_ntz, warehouse string, item_key string, canonical_name string, stock double, price double",
    )
    mixed = series.item_series(frame, name="n")
    assert [r[2] for r in rows(mixed, "dt", "item_key", "sold")] == [0, 5, 0, 3]
    alone = series.item_series(frame, name="n", per_item=True)
    assert [r[2] for r in rows(alone, "dt", "item_key", "sold")] == [0, 0, 1, 0]


def test_enriched_daily(snapshots):
    found = enrich.enrich_daily(snapshots, ["seq"])
    a1 = rows(found.filter("item_key = 'A1|Filter'"), "dt", "stock", "sold", "restocked", "price_changed")
    assert a1 == [
        (day("2025-01-30"), 10, 0, 0, False),
        (day("2025-01-31"), 7, 3, 0, True),
        (day("2025-02-01"), 7, 0, 0, False),
        (day("2025-02-02"), 12, 0, 5, False),
    ]
    nameless = found.filter("item_key = 'B2|nan'").first()
    assert nameless.canonical_name == ""
    assert found.filter("is_anomaly").count() == 0
    by_code = enrich.enrich_daily(snapshots, ["seq"], key=["warehouse", "item_code"])
    other = by_code.filter("item_key = 'A1|Filter X'").first()
    assert other.canonical_name == "Filter"


def test_same_day_twice(spark):
    frame = spark.createDataFrame(
        [
            (1, day("2025-01-01 18:00"), "A", "W", 5.0, 1.0, "n", "m"),
            (2, day("2025-01-01 09:00"), "A", "W", 7.0, None, "n", "m"),
        ],
        "seq int, dt timestamp_ntz, item_code string, warehouse string, stock double, price double, "
        "item_name string, manufacturer string",
    )
    assert daily.daily_snapshot(frame, ["seq"]).count() == 2
    one = daily.daily_by_day(enrich.with_item_key(frame), ["seq"]).collect()
    assert [(r.dt, r.stock, r.price) for r in one] == [(day("2025-01-01"), 7, 1)]


def test_top_sellers_and_drill_down(snapshots):
    enriched = enrich.enrich_daily(snapshots, ["seq"])
    top = ranking.top_sellers(enriched, n=1)
    assert rows(top, "item_code", "item_name", "warehouse", "sold") == [("A1|Filter", "Filter", "W1", 3)]
    assert series.drill_down(top, enriched).count() == 4


def test_spike_series_and_options(months):
    table = spikes.find_spikes(months)
    long = series.spike_series(table, item="A1")
    assert long.count() == 4 * 3
    assert series.spike_series(table, item="A1", n=1).count() == 3
    only = series.spike_series(table, only_spikes=True)
    assert {(r.warehouse, r.month_start.month) for r in only.collect()} == {("W2", 2)}
    assert series.name_options(table).count() == 0
    assert [r[0] for r in series.name_options(table, warehouse="W1").collect()] == ["Filter", "filter "]
    latest = ranking.tail_by_date(table, 3)
    assert [r.month for r in latest.collect()] == [2, 2, 2]
    assert "turnover" in series.export_spikes(table.drop("turnover")).columns
