"""Readers, writers, and shaping of tables."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SF_DIR, SMALL_SF_DIR, day, rows
from stockflow import fixtures as fx, queries, session
from stockflow.operators import daily, filters, flows, monthly, spikes, tables
from stockflow.plans import months as kept_months
from stockflow.schema import HEADINGS, MONTHLY, MONTHLY_DEFAULTS
from stockflow.sources import tables as st


def test_only_a_missing_table_is_empty(spark, tmp_path):
    empty = st.read_table_or_empty(spark, str(tmp_path / "none"), MONTHLY)
    assert empty.count() == 0 and "turnover" in empty.columns
    assert st.read_enriched_daily(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    (tmp_path / "hollow").mkdir()
    for path in ("bad.parquet", "hollow"):
        with pytest.raises((PySparkException, Py4JError)):
            st.read_table_or_empty(spark, str(tmp_path / path), MONTHLY).collect()
        with pytest.raises((PySparkException, Py4JError)):
            st.read_enriched_daily(spark, str(tmp_path / path)).collect()
    with pytest.raises(PySparkException):
        st.read_spikes(spark, str(tmp_path / "none"))


def test_monthly_table_comes_back(spark, months, tmp_path):
    path = str(tmp_path / "monthly")
    st.write_table(months, path, partition_by=["year", "month"])
    found = st.read_table_or_empty(spark, path, MONTHLY)
    assert found.schema.simpleString() == months.schema.simpleString()
    assert rows(found, *months.columns) == rows(months, *months.columns)
    pruned = found.filter("year = 2025 and month = 2")
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().executedPlan().toString()


def test_existing_headings_are_understood(spark, months, tmp_path):
    path = str(tmp_path / "monthly")
    theirs = {ours: name for name, ours in HEADINGS.items()}
    loose = months.withColumnsRenamed(theirs).drop("Мин_цена", "Дней_продаж")
    loose.withColumnRenamed("Всего_продано", "Продано").write.parquet(path)
    found = st.load_monthly(spark, path)
    assert rows(found, "item_code", "month", "total_sold") == rows(months, "item_code", "month", "total_sold")
    assert {(r.min_price, r.sale_days) for r in found.collect()} == {(None, 0)}
    assert found.first().month_start.day == 1


def test_spikes_come_back_from_csv(spark, months, tmp_path):
    path = str(tmp_path / "spikes")
    table = spikes.find_spikes(months)
    st.write_table(table.withColumn("is_spike", F.when(F.col("month") == 2, F.col("is_spike"))), path, "csv")
    found = st.read_spikes(spark, path, "csv")
    assert dict(found.dtypes)["month_start"] == "date"
    assert {r.is_spike for r in found.filter("month = '1'").collect()} == {True}


def test_enriched_daily_is_cleaned(spark, tmp_path):
    path = str(tmp_path / "daily")
    spark.createDataFrame(
        [(" n ", "2025-03-02", "1.5", "x"), ("n", "bad", "y", "2")],
        "item_name string, dt string, stock string, price string",
    ).write.parquet(path)
    found = st.read_enriched_daily(spark, path)
    assert rows(found, "item_name", "dt", "stock", "price", "is_anomaly") == [
        ("n", None, None, 2, False), ("n", day("2025-03-02"), 1.5, None, False),
    ]


def test_csv_is_ordered(spark, tmp_path):
    path = tmp_path / "csv"
    frame = spark.createDataFrame(
        [("2025-01-02", "W1", "b"), ("2025-01-01", "W2", "a"), ("2025-01-01", "W1", "c")],
        "dt string, warehouse string, item_code string",
    )
    st.write_csv(frame, str(path))
    lines = [l for part in sorted(path.glob("part-*")) for l in part.read_text("utf-8-sig").splitlines()]
    assert [l for l in lines if not l.startswith("dt")] == [
        "2025-01-01,W1,c", "2025-01-01,W2,a", "2025-01-02,W1,b",
    ]
    assert lines[0] == "dt,warehouse,item_code"


def test_stage_uses_the_configured_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    staged = st.stage(spark.range(5), "five")
    assert staged.count() == 5
    folder = tmp_path / spark.sparkContext.applicationId
    assert [p.name.split("-")[0] for p in folder.iterdir()] == ["five"]
    session.drop_run_dir(spark)
    assert list(tmp_path.iterdir()) == []


def test_shared_folder_comes_from_the_session(spark):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get("dir" if "checkpoint" in key else "warehouse", default)

    class Context:
        def __init__(self, master):
            self.master = master

    class Session:
        def __init__(self, master="yarn", **values):
            self.conf, self.sparkContext = Conf(**values), Context(master)

    assert session.shared_dir(Session(dir="s3://bucket/x/", warehouse="s3://w")) == "s3://bucket/x"
    assert session.shared_dir(Session(warehouse="s3://w/")) == "s3://w/staged"
    for master in ("local", "local[8]", "local[2,3]", "local[*]"):
        assert session.shared_dir(Session(master, warehouse="file:/w")) == "file:/w/staged"
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.shared_dir(Session(master, warehouse="file:/w"))


def test_shaping(spark):
    frame = spark.createDataFrame([("a", 1.0), (None, float("nan"))], "item_code string, x double")
    assert tables.require(frame, ["item_code"]).count() == 1
    assert rows(tables.nan_as_null(frame), "x") == [(None,), (1.0,)]
    assert rows(tables.fill(frame, {"item_code": ""}), "item_code") == [("",), ("a",)]
    shaped = tables.conform(frame, MONTHLY_DEFAULTS)
    assert (shaped.first().sale_days, shaped.first().avg_price) == (0, None)
    assert tables.rename(frame, {"x": "y", "z": "w"}).columns == ["item_code", "y"]
    both = tables.union_all([frame, None, frame.drop("x")])
    assert both.count() == 4 and tables.union_all([None]) is None


def test_filters(spark):
    frame = spark.createDataFrame(
        [("W1", "1", "n", True), ("W2", "2", "n", None)],
        "warehouse string, item_code string, item_name string, is_anomaly boolean",
    )
    assert filters.in_warehouses(frame, None).count() == 2
    assert filters.in_warehouses(frame, [], empty="none").count() == 0
    assert filters.in_warehouses(frame, "W1", empty="none").count() == 1
    assert filters.select_items(frame, item=2).count() == 1
    assert filters.select_items(frame, warehouse="W1", require_any=True).count() == 0
    assert filters.without_anomalies(frame).count() == 1
    assert filters.without_anomalies(frame.drop("is_anomaly")).count() == 2
    assert [r[0] for r in filters.options(frame, "warehouse").collect()] == ["W1", "W2"]
    assert filters.to_list(("a",)) == ["a"]


def test_report_formats_every_item_that_sold(spark, monkeypatch):
    sold = queries._sold(spark, SF_DIR).cache()
    many = sold.crossJoin(spark.range(100).withColumnRenamed("id", "copy"))
    many = many.withColumn("item_code", F.concat_ws("/", "item_code", "copy")).drop("copy")
    monkeypatch.setattr(queries, "_sold", lambda spark, d: many)
    shown = queries.QUERIES["format_report"](spark, SF_DIR)
    assert shown.count() == 100 * sold.count() > 1000
    assert shown.select("price_change_frac").filter("price_change_frac not like '%\\%'").count() == 0


def test_each_csv_file_starts_with_a_byte_order_mark(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"w{i % 3}", "ключ") for i in range(50)], "dt int, warehouse string, item_code string")
    st.write_csv(frame.repartition(4), str(tmp_path / "csv"))
    files = [p.read_bytes() for p in (tmp_path / "csv").glob("*.csv")]
    assert files and all(f.startswith("\ufeffdt,warehouse,item_code\n".encode()) for f in files)
    found = st.read_table_or_empty(spark, str(tmp_path / "csv"), "dt int, warehouse string, item_code string", "csv")
    assert rows(found, *found.columns) == rows(frame, *frame.columns)


# Months kept up to date.


def _files(folder) -> dict:
    return {p.relative_to(folder).as_posix(): p.stat().st_mtime_ns for p in folder.rglob("part-*")}


def _months_of(found: dict, table: str) -> set[str]:
    return {name.split("/part-")[0] for name in found if name.startswith(f"{table}/")}


def _part(snap, low: str, high: str):
    return snap.where((F.col("dt") >= F.lit(low).cast("timestamp_ntz")) & (F.col("dt") < F.lit(high).cast("timestamp_ntz")))


@pytest.fixture(scope="module")
def history(spark):
    """A year of snapshots, in which many series pause for months."""
    return _part(fx.snap(spark, SMALL_SF_DIR), "1996-01-01", "1997-01-01").cache()


@pytest.fixture(scope="module")
def whole(history):
    cleaned = tables.clean_snapshots(history)
    return monthly.monthly_summary(flows.net_of_transfers(flows.with_flows(daily.daily_snapshot(cleaned, fx.ORDER)))).cache()


def _same(found, expected) -> bool:
    columns = expected.columns
    assert found.count() == expected.count()
    return found.select(columns).exceptAll(expected).isEmpty()


def test_new_month_writes_its_own_folders_only(spark, history, whole, tmp_path):
    path = str(tmp_path)
    kept_months.update_months(_part(history, "1996-01-01", "1996-12-01"), path, fx.ORDER)
    before = _files(tmp_path)
    kept_months.update_months(_part(history, "1996-12-01", "1997-01-01"), path, fx.ORDER)
    after = _files(tmp_path)
    changed = {f: t for f, t in after.items() if before.get(f) != t}
    assert _months_of(changed, "monthly") == {"monthly/year=1996/month=12"}
    assert _months_of(changed, "daily") == {"daily/year=1996/month=12"}
    assert _months_of(changed, "last") == {f"last/as_of={1996 * 12 + 11}"}
    assert before.keys() <= after.keys()
    assert _same(kept_months.monthly_fact(spark, path), whole)
    # Again, as after a load that broke off.
    kept_months.update_months(_part(history, "1996-12-01", "1997-01-01"), path, fx.ORDER)
    assert _same(kept_months.monthly_fact(spark, path), whole)


def test_corrected_month_reaches_the_months_after_it(spark, history, whole, tmp_path):
    path = str(tmp_path)
    wrong = history.withColumn("stock", F.when(F.month("dt") == 6, F.col("stock") + 3).otherwise(F.col("stock")))
    for low, high in (("1996-01-01", "1996-07-01"), ("1996-07-01", "1996-10-01"), ("1996-10-01", "1997-01-01")):
        kept_months.update_months(_part(wrong, low, high), path, fx.ORDER)
    assert not _same(kept_months.monthly_fact(spark, path), whole)
    before = _files(tmp_path)
    kept_months.update_months(_part(history, "1996-06-01", "1996-07-01"), path, fx.ORDER)
    assert _same(kept_months.monthly_fact(spark, path), whole)
    kept = {f for f, t in _files(tmp_path).items() if before.get(f) == t}
    assert {f"monthly/year=1996/month={m}" for m in range(1, 6)} == _months_of(kept, "monthly")
    # The seeds stored for later months have been corrected, too.
    kept_months.update_months(_part(history, "1996-10-01", "1997-01-01"), path, fx.ORDER)
    assert _same(kept_months.monthly_fact(spark, path), whole)


def test_seeds_do_not_need_the_stored_last_rows(spark, history, tmp_path):
    path = str(tmp_path)
    kept_months.update_months(_part(history, "1996-01-01", "1996-06-01"), path, fx.ORDER)
    begin = 1996 * 12 + 5
    stored = kept_months.seeds_before(spark, path, begin)
    assert "as_of" in stored._jdf.queryExecution().optimizedPlan().toString()
    earlier = kept_months.seeds_before(spark, path, begin - 2)
    days = daily.daily_snapshot(tables.clean_snapshots(_part(history, "1996-01-01", "1996-04-01")), fx.ORDER)
    assert _same(earlier, kept_months._last_rows(days).select(earlier.columns))


def test_loading_nothing_changes_nothing(spark, history, tmp_path):
    kept_months.update_months(history.limit(0), str(tmp_path), fx.ORDER)
    assert _files(tmp_path) == {} and kept_months.monthly_fact(spark, str(tmp_path)).count() == 0
