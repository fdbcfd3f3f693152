"""One query per operator over the given tables. Each takes a session and a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixtures as fx
from .functions import dates, numbers, text
from .operators import (
    daily as da,
    enrich,
    filters,
    flows as fl,
    identity,
    monthly as mo,
    ranking,
    report,
    series,
    tables,
)
from .plans.analyses import run_month_analysis, run_spike_analysis
from .plans.months import monthly_fact, update_months
from .schema import DAY_KEYS, HEADINGS, ITEM_KEYS, MONTH_KEYS, MONTHLY, MONTHLY_DEFAULTS
from .session import fresh_path
from .sources import tables as st, workbooks as wb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Selections of the filter queries.
SOME_WAREHOUSES = ["WH-A", "WH-N"]
ITEM = "it-000007"
NAME = "small ring"
LINE = ["l_orderkey", "l_linenumber", "l_extendedprice"]
CODE_KEYS = ["warehouse", "item_code"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Shared inputs.


def _daily(spark, d):
    return da.daily_snapshot(fx.snap(spark, d), fx.ORDER)


def _flows(spark, d):
    return fl.with_flows(_daily(spark, d), measured=fx.shelf_lines(spark, d))


def _net(spark, d):
    return fl.net_of_transfers(_flows(spark, d))


def _monthly(spark, d):
    return mo.monthly_summary(_net(spark, d))


def _totals(spark, d):
    return mo.item_totals(_monthly(spark, d))


def _spikes(spark, d):
    return run_spike_analysis(_monthly(spark, d))


def _fast(spark, d):
    return ranking.top_fast(_totals(spark, d))


def _sold(spark, d):
    return _totals(spark, d).filter(F.col("total_sold") > 0)


def _analysis(spark, d, name):
    return run_month_analysis(fx.snap(spark, d), fx.ORDER)[name]


def _saved(spark, name, df):
    """A result as it is read back after writing."""
    path = fresh_path(spark, name)
    st.write_table(df, path)
    return spark.read.parquet(path)


def _all_series(spark, d):
    return series.item_series(fx.enriched(spark, d), per_item=True, require_any=False)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means of means depend on the order of summing; compare them to six places.

    A mean that lies midway between two such numbers goes to the upper one, whatever its last bit is.
    """
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in columns or ["avg_price"]})


def _month_stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("month_start", F.col("month_start").cast("timestamp_ntz"))


# Scalar functions and projections.


def _codes(spark, d):
    code = F.concat("p_brand", F.lit("-"), "p_type", F.lit("_"), "p_name")
    return fx.table(spark, d, "part").select("p_partkey", code.alias("code"))


@query
def norm_code(spark, d):
    return _codes(spark, d).withColumn("code_norm", text.norm_code("code"))


@query
def norm_code_weak(spark, d):
    return _codes(spark, d).withColumn("code_norm", text.norm_code("code", drop="- "))


@query
def norm_name(spark, d):
    return fx.snap(spark, d).select(
        *LINE, "item_name", text.norm_name("item_name").alias("item_name_norm")
    )


@query
def strip_ws(spark, d):
    padded = F.concat(F.lit(" \t"), "text", F.lit(" 　\n"))
    return fx.table(spark, d, "documents").select("doc_id", text.strip_ws(padded).alias("stripped"))


@query
def parse_dt(spark, d):
    formats = ("yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy", "dd/MM/yyyy HH:mm")
    return fx.dated_text(spark, d).select(
        "event_id", "date_text", dates.parse_dt("date_text", formats).alias("parsed")
    )


@query
def day_trunc(spark, d):
    return fx.table(spark, d, "events").select("event_id", dates.day("ts").alias("day"))


@query
def year_month(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("dt"))
    return dates.with_year_month(orders)


@query
def month_start(spark, d):
    start = dates.month_start(F.year("o_orderdate"), F.month("o_orderdate"))
    return fx.table(spark, d, "orders").select(
        "o_orderkey", start.cast("timestamp_ntz").alias("month_start")
    )


@query
def to_number(spark, d):
    return fx.dated_text(spark, d).select(
        "event_id",
        "number_text",
        numbers.to_number("number_text").alias("number"),
        numbers.to_number("number_text", default=0).alias("number_or_zero"),
    )


@query
def to_flag(spark, d):
    kind = F.col("event_type")
    flag = F.when(kind == "click", "false").when(kind != "error", "true")
    return fx.table(spark, d, "events").select(
        "event_id", flag.alias("flag_text"), numbers.to_flag(flag).alias("flag")
    )


@query
def conform(spark, d):
    partial = _monthly(spark, d).drop("avg_price", "sale_days")
    return tables.conform(partial, MONTHLY_DEFAULTS).select(
        *MONTH_KEYS, "total_sold", "avg_price", "sale_days"
    )


@query
def rename(spark, d):
    ours = ["dt", "item_code", "warehouse", "stock", "price"]
    found = {ours_name: theirs for theirs, ours_name in HEADINGS.items() if ours_name in ours}
    theirs = fx.snap(spark, d).select(*LINE, *[F.col(c).alias(found[c]) for c in ours])
    return tables.rename(theirs, HEADINGS)


@query
def round_prices(spark, d):
    prices = _monthly(spark, d).select(*MONTH_KEYS, *ranking.PRICE_COLUMNS)
    return ranking.round_prices(prices)


@query
def sold_restocked(spark, d):
    sold, restocked = numbers.sold_restocked("stock_diff")
    return _flows(spark, d).select(
        *DAY_KEYS, "stock_diff", sold.alias("sold"), restocked.alias("restocked")
    )


@query
def item_turnover(spark, d):
    return _monthly(spark, d).select(
        *MONTH_KEYS, "total_sold", "sale_days",
        numbers.turnover("total_sold", "sale_days").alias("turnover"),
    )


@query
def turnover_by_avg_stock(spark, d):
    avg_stock = _daily(spark, d).groupBy(*ITEM_KEYS).agg(F.avg("stock").alias("avg_stock"))
    totals = _totals(spark, d).select(*ITEM_KEYS, "total_sold").join(avg_stock, ITEM_KEYS)
    return ranking.turnover_by_avg_stock(totals).drop("avg_stock")


@query
def spike_turnover(spark, d):
    bare = _spikes(spark, d).drop("turnover")
    return series.spike_turnover(bare).select(*MONTH_KEYS, "total_sold", "turnover")


@query
def price_change(spark, d):
    absolute, percent = numbers.price_change("open_price", "close_price")
    return mo.monthly_open_close(_flows(spark, d)).withColumns(
        {"price_change_abs": absolute, "price_change_pct": percent}
    )


@query
def price_change_fraction(spark, d):
    fraction = numbers.price_change_fraction("open_price", "close_price")
    return mo.monthly_open_close(_flows(spark, d)).withColumn("price_change_frac", fraction)


@query
def least_days(spark, d):
    """Snapshot rows in stock, of which a day may have several, against distinct days."""
    counted = dates.with_year_month(fx.snap(spark, d)).groupBy(*MONTH_KEYS)
    counted = counted.agg(F.count_if(F.col("stock") > 0).alias("in_stock"), F.count_distinct("dt").alias("days"))
    return counted.select(*MONTH_KEYS, "in_stock", "days", F.least("in_stock", "days").alias("in_stock_days"))


@query
def classify_day(spark, d):
    return _all_series(spark, d).select(
        "warehouse", "item_key", "dt", "is_spike", "price_changed", "day_class", "emphasis"
    )


@query
def item_key(spark, d):
    return enrich.with_item_key(fx.snap(spark, d)).select(*LINE, "item_key")


@query
def name_changed(spark, d):
    return identity.canonical_names(fx.snap(spark, d), CODE_KEYS).select(
        *LINE, "item_name", "canonical_name", "name_changed"
    )


@query
def fill_nulls(spark, d):
    return tables.fill(fx.snap(spark, d), {"stock": 0.0, "price": 0.0}).select(
        *LINE, "stock", "price"
    )


@query
def fmt_date(spark, d):
    return fx.table(spark, d, "orders").select(
        "o_orderkey", dates.fmt_date("o_orderdate").alias("date_text")
    )


@query
def format_report(spark, d):
    sold = ranking.rank_input(_rounded(_sold(spark, d)), "total_sold")
    shown = report.format_report(ranking.export_columns(sold))
    return shown.select(
        *ITEM_KEYS, "avg_price", "open_price", "close_price", "total_restocked", "turnover",
        "price_change_frac",
    )


# Filters.


@query
def require_keys(spark, d):
    return tables.require(fx.snap(spark, d), ["stock", "price"]).select(*LINE, "stock", "price")


@query
def inflows(spark, d):
    return fl.inflows(_flows(spark, d))


@query
def outflows(spark, d):
    return fl.outflows(_flows(spark, d))


@query
def in_warehouses(spark, d):
    return filters.in_warehouses(fx.snap(spark, d), SOME_WAREHOUSES).select(
        *LINE, "warehouse", "stock"
    )


@query
def select_items(spark, d):
    chosen = filters.select_items(fx.snap(spark, d), warehouse="WH-A", item=ITEM)
    return chosen.select(*LINE, "warehouse", "item_code", "item_name", "stock")


@query
def select_items_guard(spark, d):
    snap = fx.snap(spark, d)
    both = tables.union_all(
        [
            filters.select_items(snap, warehouse="WH-A", require_any=True),
            filters.select_items(snap, name=NAME, require_any=True),
        ]
    )
    return both.select(*LINE, "warehouse", "item_code", "item_name")


@query
def without_anomalies(spark, d):
    marked = fx.snap(spark, d).withColumn("is_anomaly", F.col("l_tax") == 0.08)
    return filters.without_anomalies(marked).select(*LINE, "stock", "is_anomaly")


# Movements, transfers and days.


@query
def daily_snapshot(spark, d):
    return _daily(spark, d)


@query
def daily_rollup(spark, d):
    return da.daily_rollup(fx.snap(spark, d), fx.ORDER)


@query
def with_flows(spark, d):
    return _flows(spark, d)


@query
def detect_transfers(spark, d):
    return fl.detect_transfers(_flows(spark, d))


@query
def net_of_transfers(spark, d):
    return _net(spark, d).select(*DAY_KEYS, "stock_diff", "sold", "restocked")


@query
def price_days(spark, d):
    return mo.price_days(dates.with_year_month(_daily(spark, d)))


@query
def price_days_join(spark, d):
    joined = mo.price_days_join(dates.with_year_month(_daily(spark, d)))
    return joined.withColumn("months", F.array_join("months", ","))


# Months, totals and rankings.


@query
def monthly_price_range(spark, d):
    return mo.monthly_price_range(dates.with_year_month(_daily(spark, d)))


@query
def monthly_open_close(spark, d):
    return mo.monthly_open_close(dates.with_year_month(_daily(spark, d)))


@query
def monthly_summary(spark, d):
    return _monthly(spark, d)


@query
def item_totals(spark, d):
    return _rounded(_totals(spark, d))


@query
def top_fast(spark, d):
    return _rounded(_fast(spark, d))


@query
def top_slow(spark, d):
    return _rounded(ranking.top_slow(_totals(spark, d)))


@query
def top_restocked(spark, d):
    return _rounded(ranking.top_restocked(_totals(spark, d)))


@query
def rank_base(spark, d):
    return ranking.rank_base(_monthly(spark, d), "total_sold")


@query
def rank_fast(spark, d):
    return ranking.rank_fast(_sold(spark, d), n=100, every=True)


@query
def rank_restock(spark, d):
    return ranking.rank_restock(_totals(spark, d), n=100, every=True)


@query
def export_top_fast(spark, d):
    return ranking.export_top_fast(_sold(spark, d), n=100, every=True)


@query
def export_top_restock(spark, d):
    return ranking.export_top_restock(_totals(spark, d), n=100, every=True)


# Identities and names.


@query
def identity_conflicts(spark, d):
    return identity.identity_conflicts(fx.snap(spark, d))


@query
def canonical_names(spark, d):
    return identity.canonical_names(fx.snap(spark, d), CODE_KEYS).select(
        *LINE, *CODE_KEYS, "item_name", "canonical_name", "name_changed"
    )


@query
def name_variants(spark, d):
    return identity.name_variants(fx.snap(spark, d), CODE_KEYS)


@query
def variants_text(spark, d):
    """The names of every item and warehouse."""
    return identity.variants_text(identity.name_variants(fx.snap(spark, d), CODE_KEYS), CODE_KEYS)


# Spikes by month.


@query
def find_spikes(spark, d):
    return _month_stamp(_spikes(spark, d))


@query
def tail_by_date(spark, d):
    return _month_stamp(ranking.tail_by_date(_spikes(spark, d))).select(
        *ITEM_KEYS, "month_start", "total_sold", "is_spike"
    )


@query
def spike_series(spark, d):
    return _month_stamp(series.spike_series(_spikes(spark, d)))


@query
def name_options(spark, d):
    return series.name_options(_spikes(spark, d), warehouse="WH-A")


@query
def export_spikes(spark, d):
    chosen = series.export_spikes(_spikes(spark, d))
    return chosen.select(*MONTH_KEYS, "total_sold", "trailing_avg", "is_spike", "turnover")


# The enriched daily table and its series.


@query
def enrich_daily(spark, d):
    return fx.enriched(spark, d)


@query
def enrich_daily_by_code(spark, d):
    return enrich.enrich_daily(fx.snap(spark, d), fx.ORDER, key=CODE_KEYS)


@query
def daily_by_day(spark, d):
    keyed = enrich.with_item_key(fx.snap(spark, d))
    return da.daily_by_day(keyed, fx.ORDER).drop("canonical_name")


@query
def daily_metrics(spark, d):
    keyed = enrich.with_item_key(fx.snap(spark, d))
    return enrich.daily_metrics(keyed, fx.ORDER).drop("canonical_name")


@query
def price_changed(spark, d):
    return fx.enriched(spark, d).select("warehouse", "item_key", "dt", "price", "price_changed")


@query
def item_line(spark, d):
    return series.item_line(fx.enriched(spark, d))


@query
def item_series(spark, d):
    return _all_series(spark, d)


@query
def item_series_by_name(spark, d):
    return series.item_series(fx.enriched(spark, d), name=NAME)


@query
def day_spikes(spark, d):
    """Spikes of the deduplicated days, with the code itself as the item."""
    days = _daily(spark, d).select(
        "dt", "warehouse", F.col("item_code").alias("item_key"),
        F.col("item_name").alias("canonical_name"), "stock", "price",
    )
    found = series.item_series(days, per_item=True, require_any=False)
    return found.select("warehouse", "item_key", "dt", "sold", "trailing_avg", "is_spike")


@query
def top_sellers(spark, d):
    return ranking.top_sellers(fx.enriched(spark, d))


@query
def drill_down(spark, d):
    daily = fx.enriched(spark, d)
    return series.drill_down(ranking.top_sellers(daily), daily).select(
        "warehouse", "item_key", "canonical_name", "dt", "stock", "sold"
    )


def _stored(spark, d):
    """The enriched table as it is kept for look-ups."""
    path = fresh_path(spark, "enriched_by_item")
    return st.store_by_key(fx.enriched(spark, d), path.rsplit("/", 1)[1].replace("-", "_"), path, buckets=16)


@query
def stored_item_line(spark, d):
    return series.item_line(_stored(spark, d), item=f"{ITEM}|{NAME}")


@query
def stored_drill_down(spark, d):
    daily = _stored(spark, d)
    return series.drill_down(ranking.top_sellers(daily), daily).select(
        "warehouse", "item_key", "canonical_name", "dt", "stock", "sold"
    )


@query
def options_warehouse(spark, d):
    return filters.options(fx.enriched(spark, d), "warehouse")


@query
def options_item(spark, d):
    return filters.options(fx.enriched(spark, d), "item_key")


@query
def options_name(spark, d):
    return filters.options(fx.enriched(spark, d), "canonical_name")


@query
def column_widths(spark, d):
    shown = _monthly(spark, d).select(
        *MONTH_KEYS, "item_name", "manufacturer", "total_sold", "total_restocked", "last_stock",
        "min_price", "max_price", "open_price", "sale_days",
        (F.col("total_sold") * 1_000_000 + 0.5).alias("large"), (F.col("max_price") / 100_000).alias("small"),
    )
    return report.column_widths(shown)


# Sources, sinks and whole analyses.


@query
def union_all(spark, d):
    """Two tables with different columns: lines as snapshots, and parts that are not on a shelf."""
    lines = fx.snap(spark, d).select(*LINE, "dt", "item_code", "warehouse", "stock", "price")
    parts = fx.table(spark, d, "part").select(F.col("p_brand").alias("item_code"), F.col("p_name").alias("item_name"))
    return tables.union_all([lines, None, parts])


@query
def snapshots_from_grid(spark, d):
    return wb.snapshots_from_grid(fx.grid(spark, d))


@query
def load_snapshots(spark, d):
    """The stored grids of all warehouses, a folder for each, and of one that has none."""
    path = fresh_path(spark, "grids")
    st.write_table(fx.grid(spark, d), path, partition_by=["warehouse"])
    stored = spark.read.schema("warehouse string").parquet(path).where(F.col("warehouse").isNotNull())
    names = [r.warehouse for r in stored.distinct().collect()]
    folders = {name: f"{path}/warehouse={name}" for name in [*names, "WH-none"]}
    return wb.load_snapshots(spark, folders, wb.scan_grids)


@query
def resolve_as_of(spark, d):
    return fx.dated_text(spark, d).select(
        "event_id",
        "date_text",
        dates.resolve_as_of("date_text", "file_ts").alias("as_of"),
        dates.as_of_source("date_text").alias("date_source"),
    )


@query
def ingest_audit(spark, d):
    return wb.ingest_audit(fx.grid(spark, d))


@query
def read_enriched_daily(spark, d):
    path = fresh_path(spark, "enriched")
    st.write_table(fx.enriched(spark, d), path, partition_by=["warehouse"])
    return st.read_enriched_daily(spark, path)


@query
def load_monthly(spark, d):
    path = fresh_path(spark, "monthly")
    theirs = {ours: name for name, ours in HEADINGS.items()}
    st.write_table(_monthly(spark, d).withColumnsRenamed(theirs), path)
    return _month_stamp(st.load_monthly(spark, path)).select(
        *MONTH_KEYS, "month_start", "item_name", "total_sold", "avg_price", "price_change_pct"
    )


@query
def roundtrip_parquet(spark, d):
    path = fresh_path(spark, "monthly")
    st.write_table(_monthly(spark, d), path, partition_by=["year", "month"])
    return st.read_table_or_empty(spark, path, MONTHLY)


@query
def roundtrip_csv(spark, d):
    path = fresh_path(spark, "rollup")
    st.write_csv(da.daily_rollup(fx.snap(spark, d), fx.ORDER), path)
    schema = (
        "dt timestamp_ntz, item_code string, warehouse string, total_sold double, day_open_price double"
    )
    return st.read_table_or_empty(spark, path, schema, "csv")


@query
def month_analysis(spark, d):
    """Rows of every table of the month analysis."""
    results = run_month_analysis(fx.snap(spark, d), fx.ORDER, staged=True)
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in results.items()
    ]
    return tables.union_all(counts)


@query
def month_update(spark, d):
    """The monthly fact, of which the first half of the months was loaded before the second."""
    path, snap = fresh_path(spark, "months"), fx.snap(spark, d)
    later = F.col("dt") >= F.lit("1997-01-01").cast("timestamp_ntz")
    for part in (snap.where(~later), snap.where(later)):
        update_months(part, path, fx.ORDER)
    return monthly_fact(spark, path)


@query
def month_analysis_totals(spark, d):
    """Item totals of the month analysis, which cleans the codes first."""
    return _rounded(_analysis(spark, d, "item_totals"))


@query
def month_analysis_monthly(spark, d):
    return _analysis(spark, d, "monthly")


@query
def month_analysis_transfers(spark, d):
    return _saved(spark, "transfers", _analysis(spark, d, "transfers"))


@query
def month_analysis_conflicts(spark, d):
    return _saved(spark, "conflicts", _analysis(spark, d, "identity_conflicts"))


@query
def month_analysis_top_fast(spark, d):
    return _rounded(_saved(spark, "top_fast", _analysis(spark, d, "top_fast")))


@query
def month_analysis_top_slow(spark, d):
    return _rounded(_saved(spark, "top_slow", _analysis(spark, d, "top_slow")))


@query
def month_analysis_top_restocked(spark, d):
    return _rounded(_saved(spark, "top_restocked", _analysis(spark, d, "top_restocked")))


@query
def month_analysis_rollup(spark, d):
    return _analysis(spark, d, "daily_rollup")


@query
def export_saved(spark, d):
    """An export as its users read it back."""
    return _saved(spark, "export", ranking.export_top_fast(_sold(spark, d), n=100, every=True))


@query
def read_spikes(spark, d):
    """The spike table, saved by its analysis and read back."""
    path = fresh_path(spark, "spikes")
    run_spike_analysis(_monthly(spark, d), path=path)
    return _month_stamp(st.read_spikes(spark, path))
