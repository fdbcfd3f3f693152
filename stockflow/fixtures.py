"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions.dates import day
from .operators.enrich import enrich_daily

#: The load order of snapshots is one number, see ``load_rank``.
ORDER = ["load_rank"]
LINES = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_tax"]

# Parts that share an item code, and suppliers that share a site besides the three main warehouses.
PARTS_PER_ITEM = 20
SUPPLIERS_PER_SITE = 50

# Orders per workbook of a warehouse and day, which keeps a workbook below a sheet's row limit.
ORDERS_PER_BOOK = 100_000


def load_rank() -> Column:
    """Order, line, part within its group and supplier as one number, which tells the lines of an item and day apart."""
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 32 + F.col("l_partkey") % PARTS_PER_ITEM
    return line * 32_768 + F.col("l_suppkey") % 32_768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item(part: str) -> Column:
    """The code of a part's group."""
    group = F.floor(F.col(part) / PARTS_PER_ITEM).cast("bigint")
    return F.concat(F.lit("it-"), F.lpad(group.cast("string"), 6, "0")).alias("item_code")


def shelf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item and time of the order lines behind the snapshots, which takes no join with the parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("timestamp_ntz").alias("dt"), _item("l_partkey"))


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock snapshots: order lines as shelf records of their group of parts, at their supplier's warehouse.

    Groups and warehouses grow with the parts and suppliers. Parts of one name are in several groups, and a
    tenth of the groups never sells.
    """
    group = F.floor(F.col("l_partkey") / PARTS_PER_ITEM).cast("bigint")
    supplier = F.col("l_suppkey") % 5
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    number, taxed = F.col("l_linenumber"), F.col("l_tax") == 0.08
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("dt"),
        _item("l_partkey"),
        F.when(supplier == 0, "WH-A")
        .when(supplier == 1, "WH-N")
        .when(supplier == 2, "WH-R")
        .otherwise(F.concat(F.lit("WH-"), F.floor(F.col("l_suppkey") / SUPPLIERS_PER_SITE).cast("string")))
        .alias("warehouse"),
        F.when(group % 10 == 9, F.lit(5.0))
        .when(F.col("l_quantity") != 50, F.col("l_quantity") - 1)
        .alias("stock"),
        F.when(taxed & (number == 2), F.lit(0.0))
        .when(~(taxed & (number == 1)), F.round(100 * (1 - F.col("l_discount")), 2))
        .alias("price"),
        F.when(number == 7, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" дефект")))
        .otherwise(F.col("p_name"))
        .alias("item_name"),
        F.col("p_brand").alias("manufacturer"),
        *LINES,
        load_rank().alias("load_rank"),
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_daily(snap(spark, sf_dir), ORDER)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell grid of one workbook per warehouse, day and batch of orders.

    Workbooks of the first day of a month have no date cell and fall back to the file's time.
    """
    book = F.concat_ws(
        "_",
        F.concat(F.col("warehouse"), F.lit("/"), F.date_format("dt", "yyyyMMdd")),
        F.concat(
            F.floor(F.col("l_orderkey") / ORDERS_PER_BOOK).cast("bigint").cast("string"), F.lit(".xlsx")
        ),
    )
    lines = snap(spark, sf_dir).withColumn("src_file", book)
    place = Window.partitionBy("src_file").orderBy(*ORDER)
    nothing = F.lit(None).cast("string")
    items = lines.select(
        "src_file",
        (F.row_number().over(place) + 4).alias("src_row"),
        "warehouse",
        "dt",
        nothing.alias("a"),
        F.col("item_name").alias("b"),
        F.col("stock").cast("string").alias("c"),
        F.col("price").cast("string").alias("d"),
        F.col("manufacturer").alias("e"),
        F.concat(F.lit(" "), F.col("item_code")).alias("f"),
    )
    headers = lines.select("src_file", "warehouse", "dt").distinct().select(
        "src_file",
        F.lit(2).alias("src_row"),
        "warehouse",
        "dt",
        F.when(F.dayofmonth("dt") != 1, F.date_format("dt", "dd.MM.yyyy")).alias("a"),
        *[nothing.alias(c) for c in "bcdef"],
    )
    return headers.unionByName(items).withColumn(
        "file_ts", (F.col("dt") + F.expr("interval 18 hours")).cast("timestamp_ntz")
    ).drop("dt")


def dated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time and value as text in several spellings, some of them unreadable."""
    kind, ts, value = F.col("event_type"), F.col("ts"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", "n/a")
        .when(kind == "click", F.date_format("ts", "dd.MM.yyyy"))
        .when(kind == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 4 == 0, F.date_format("ts", "MMMM d, yyyy"))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "d MMMM yyyy HH:mm"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm"))
        .alias("date_text"),
        F.when(kind == "error", F.col("props"))
        .when(kind == "click", F.concat(F.lit(" "), value.cast("string"), F.lit("\t")))
        .when(kind == "view", F.replace(value.cast("string"), F.lit("."), F.lit(",")))
        .otherwise(value.cast("string"))
        .alias("number_text"),
        day(ts).alias("file_ts"),
        "value",
    )
