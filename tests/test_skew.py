"""A third of all rows under one key must not end up in one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from stockflow.operators import daily, flows, halo, identity, monthly, skew

ROWS = 120_000
HOT_ITEM = "hot"


@pytest.fixture(scope="module")
def skewed(spark):
    """One item in one warehouse holds a third of the rows, at hourly times over years."""
    hot = F.col("id") % 3 == 0
    hour = F.floor(F.col("id") / 3).cast("bigint") * 3600
    return spark.range(ROWS).select(
        F.col("id").cast("int").alias("seq"),
        F.timestamp_seconds(F.lit(1_500_000_000) + hour).cast("timestamp_ntz").alias("dt"),
        F.when(hot, HOT_ITEM).otherwise(F.concat(F.lit("i"), F.col("id") % 500)).alias("item_code"),
        F.when(hot, "w0").otherwise(F.concat(F.lit("w"), F.col("id") % 5)).alias("warehouse"),
        (F.col("id") * 7 % 41).cast("double").alias("stock"),
        (F.col("id") % 13).cast("double").alias("price"),
        F.when(hot, F.concat(F.lit("n"), F.col("id") % 4)).otherwise("other").alias("item_name"),
        F.lit("m").alias("manufacturer"),
    )


def _largest_share(df) -> float:
    sizes = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_series_of_a_hot_item_is_spread(spark, skewed):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        moved = flows.with_flows(daily.daily_snapshot(skewed, ["seq"]))
        assert _largest_share(moved) < 0.12
        assert _largest_share(flows.net_of_transfers(moved)) < 0.12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("hot", [False, True])
def test_placement_is_not_put_together(spark, skewed, hot):
    """Each task of the month chain holds its rows several times over, so the session's number of tasks stays."""
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        some = skewed if hot else skewed.filter(F.col("item_code") != HOT_ITEM)
        moved = flows.with_flows(daily.daily_snapshot(some, ["seq"]))
        assert moved.rdd.getNumPartitions() >= 32
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_item_sold_everywhere_at_once_is_spread(spark):
    """All rows of the hot item are of one day, in thousands of warehouses: slices of time alone would not part them."""
    wide = spark.range(30_000).select(
        F.timestamp_seconds(F.lit(1_500_000_000) + F.col("id") % 3).cast("timestamp_ntz").alias("dt"),
        F.when(F.col("id") % 3 == 0, HOT_ITEM).otherwise(F.concat(F.lit("i"), F.col("id") % 700)).alias("item_code"),
        F.concat(F.lit("w"), "id").alias("warehouse"),
        (F.col("id") % 41).cast("double").alias("stock"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        moved = flows.with_flows(wide)
        assert _largest_share(moved) < 0.12 and moved.count() == 30_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_frequent_values_are_few_and_named(spark, skewed):
    found = halo.frequent(skewed, "item_code")
    assert found == {HOT_ITEM: 11}  # a third of 32 shares
    assert halo.frequent(skewed.limit(0), "item_code") == {}
    # Ten values share the rows alike, and each is more than one of the 32 shares.
    assert len(halo.frequent(spark.range(1000).select((F.col("id") % 10).cast("string").alias("k")), "k")) == 10
    assert halo.frequent(spark.range(1000).select((F.col("id") % 100).cast("string").alias("k")), "k") == {}


def test_names_of_a_hot_key_are_joined_salted(spark, skewed):
    """Half of the rows have one key, and adaptive execution does not help."""
    keys = ["warehouse", "item_code"]
    half = skewed.withColumn("item_code", F.when(F.col("seq") % 2 == 0, HOT_ITEM).otherwise(F.col("item_code"))).withColumn(
        "warehouse", F.when(F.col("seq") % 2 == 0, "w0").otherwise(F.col("warehouse"))
    )
    settings = {
        "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "32", "spark.sql.autoBroadcastJoinThreshold": "-1"
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        named = identity.canonical_names(half, keys)
        assert _largest_share(named) < 0.12
        plain = half.join(identity.name_table(half, keys), keys, "left").select("seq", "canonical_name")
        assert named.select("seq", "canonical_name").exceptAll(plain).count() == 0 and named.count() == ROWS
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_salted_join_keeps_rows_without_a_partner(spark):
    rows = spark.createDataFrame([("a", i) for i in range(90)] + [("b", 1), (None, 2), ("c", 3)], "k string, v long")
    table = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "N")], "k string, name string")
    found = {r.k: r.name for r in skew.salted_join(rows, table, ["k"]).collect()}
    assert found == {"a": "A", "b": "B", "c": None, None: None}
    assert skew.salted_join(rows, table, ["k"]).count() == 93 and skew.salted_join(rows, table, ["k"], "inner").count() == 91
    with pytest.raises(ValueError, match="left or inner"):
        skew.salted_join(rows, table, ["k"], "full")


def test_hot_results_stay_whole(skewed):
    moved = flows.with_flows(daily.daily_snapshot(skewed, ["seq"]))
    hot = sorted(r[0] for r in skewed.filter(F.col("item_code") == HOT_ITEM).select("seq").collect())
    stocks = [float(s * 7 % 41) for s in hot]
    sold = sum(max(a - b, 0) for a, b in zip(stocks, stocks[1:]))
    found = moved.filter(F.col("item_code") == HOT_ITEM).agg(F.count("dt"), F.sum("sold")).first()
    assert tuple(found) == (len(hot), sold)


def test_copies_of_one_day_collapse_before_the_shuffle(spark, skewed):
    same = skewed.withColumn("dt", F.lit("2025-01-01").cast("timestamp_ntz"))
    days = daily.daily_snapshot(same, ["seq"])
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min_by") > plan.index("Exchange")
    assert days.filter(F.col("item_code") == HOT_ITEM).count() == 1


def test_names_of_a_hot_key_are_counted_first(skewed):
    keys = ["warehouse", "item_code"]
    found = identity.name_table(skewed.filter(F.col("item_code") == HOT_ITEM), keys)
    assert rows(found, "canonical_name") == [("n0",)]
    names = identity.variants_text(identity.name_variants(skewed.filter(F.col("item_code") == HOT_ITEM), keys), keys)
    assert rows(names, "name_variants") == [("n0, n1, n2, n3",)]
    assert identity.identity_conflicts(skewed).count() == len(
        skewed.filter("item_name = 'other'").select("item_code").distinct().collect()
    )


def test_rows_without_movement_form_no_group(spark):
    """Thousands of warehouses without movement on one day are spread by warehouse."""
    still = spark.range(3000).select(
        F.lit("x").alias("item_code"),
        F.concat(F.lit("w"), "id").alias("warehouse"),
        F.explode(F.array(*[F.lit(f"2025-01-0{i}").cast("timestamp_ntz") for i in (1, 2)])).alias("dt"),
        F.lit(1.0).alias("stock"),
        F.lit(1.0).alias("price"),
        F.lit("n").alias("item_name"),
        F.lit("m").alias("manufacturer"),
    )
    net = flows.net_of_transfers(flows.with_flows(still))
    found = monthly.monthly_summary(net).agg(F.sum("total_sold"), F.count("year")).first()
    assert tuple(found) == (0, 3000)
