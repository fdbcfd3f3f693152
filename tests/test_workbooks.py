"""Reading folders of workbooks."""

from __future__ import annotations

import glob
import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

import workbook_files as wf
from conftest import SF_DIR, day, rows
from stockflow import fixtures as fx, queries
from stockflow.plans.analyses import run_from_folders, write_month_analysis
from stockflow.sources import workbooks as wb

RICH_SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="2"><c r="A2" s="1"><v>45718</v></c></row>
<row r="4"><c r="F4" t="s"><v>0</v></c></row>
<row r="5"><c r="B5" t="s"><v>1</v></c><c r="C5"><v>3.5</v></c><c r="F5"><v>7</v></c></row>
<row r="6"><c r="B6" t="s"><v>0</v></c><c r="C6"><v>1</v></c></row>
<row r="8"><c r="B8" t="str"><v>made</v></c><c r="D8"><v>2</v></c><c r="F8" t="s"><v>0</v></c><c r="AA8"><v>9</v></c></row>
</sheetData></worksheet>"""
RICH_PARTS = {
    "xl/workbook.xml": """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
 xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><bookViews><workbookView activeTab="1"/></bookViews>
 <sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>""",
    "xl/_rels/workbook.xml.rels": """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
 <Relationship Id="r1" Target="worksheets/one.xml"/><Relationship Id="r2" Target="/xl/worksheets/two.xml"/></Relationships>""",
    "xl/sharedStrings.xml": """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
 <si><t> code-1 </t></si><si><r><t>rich </t></r><r><t>name</t></r><rPh><t>no</t></rPh></si></sst>""",
    "xl/styles.xml": """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
 <numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts>
 <cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>""",
    "xl/worksheets/one.xml": "<worksheet/>",
    "xl/worksheets/two.xml": RICH_SHEET,
}


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, content in parts.items():
            book.writestr(name, content)
    return out.getvalue()


def _plain(date: str | None, items: list[tuple]) -> bytes:
    grid = [{"src_row": 2, "a": date, **dict.fromkeys("bcdef")}]
    grid += [
        {"src_row": 5 + i, "a": None, **dict(zip("bcdef", item))} for i, item in enumerate(items)
    ]
    return wf.encode_workbook(grid)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    one, two = tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("two")
    items = [("Filter", "5", "10.5", "M", "a-1"), ("Gasket", None, None, None, "b_2"), ("no code", "1", "1", "M", None)]
    (one / "day1.xlsx").write_bytes(_plain("01.03.2025", items))
    (one / "day2.xlsx").write_bytes(_plain(None, items[:1]))
    (one / "rich.xlsx").write_bytes(_zip(RICH_PARTS))
    (one / "broken.xlsx").write_bytes(b"no workbook")
    (one / "cut.xlsx").write_bytes(_zip({**RICH_PARTS, "xl/worksheets/two.xml": RICH_SHEET[:-40]}))
    (one / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    (one / "notes.txt").write_text("ignored")
    (two / "day1.xlsx").write_bytes(_plain("01.03.2025", items[:1]))
    stamp = day("2025-03-05 12:00").timestamp()
    offset = -time.timezone
    os.utime(one / "day2.xlsx", (stamp + offset, stamp + offset))
    return {"W1": str(one), "W2": str(two), "W3": str(one / "missing")}


def _short(found):
    return [(r[0].rsplit("/", 1)[-1], *r[1:]) for r in found]


def test_grid_rows_become_snapshots(spark, folders):
    found = wb.snapshots_from_grid(wb.scan_workbooks(spark, folders["W1"], "W1"))
    columns = ["src_file", "src_row", "dt", "item_code", "item_name", "stock", "price", "manufacturer"]
    assert _short(rows(found, *columns)) == [
        ("day1.xlsx", 5, day("2025-03-01"), "a-1", "Filter", 5, 10.5, "M"),
        ("day1.xlsx", 6, day("2025-03-01"), "b_2", "Gasket", 0, 0, None),
        ("day2.xlsx", 5, day("2025-03-05 12:00"), "a-1", "Filter", 5, 10.5, "M"),
        ("rich.xlsx", 5, day("2025-03-02"), "7", "rich name", 3.5, 0, None),
        ("rich.xlsx", 8, day("2025-03-02"), "code-1", "made", 0, 2, None),
    ]


def test_bad_files_are_isolated_and_reported(spark, folders):
    audit = wb.ingest_audit(wb.scan_workbooks(spark, folders["W1"], "W1"))
    found = {r[0]: r[1:] for r in _short(rows(audit, "src_file", "item_lines", "date_source", "error"))}
    assert found["day1.xlsx"] == (2, "cell", None)
    assert found["day2.xlsx"] == (1, "file", None)
    assert found["rich.xlsx"] == (2, "cell", None)
    assert found["old.xls"] == (0, None, "unsupported .xls")
    assert found["broken.xlsx"][:2] == (0, None) and "BadZipFile" in found["broken.xlsx"][2]
    assert found["cut.xlsx"][:2] == (0, None) and "ParseError" in found["cut.xlsx"][2]
    assert len(found) == 6


def test_missing_folders_are_skipped(spark, folders):
    found = wb.load_snapshots(spark, folders)
    assert {r[0] for r in rows(found, "warehouse")} == {"W1", "W2"}
    with pytest.raises(ValueError):
        wb.load_snapshots(spark, {"W3": folders["W3"]})


def test_analysis_of_folders(spark, folders, tmp_path):
    results = run_from_folders(spark, folders)
    assert rows(results["item_totals"], "item_code", "warehouse", "in_stock_days") == [
        ("7", "W1", 1), ("A1", "W1", 2), ("A1", "W2", 1), ("B2", "W1", 0), ("CODE1", "W1", 0),
    ]
    write_month_analysis(results, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(results)
    assert spark.read.parquet(str(tmp_path / "monthly")).count() == results["monthly"].count()


def test_decoded_files_equal_the_grid_they_came_from(spark):
    from conftest import SF_DIR

    columns = ["src_file", "src_row", "a", "b", "e", "f"]
    grid = fx.grid(spark, SF_DIR).select(*columns)
    decoded = wb.decode_workbooks(wf.workbook_files(spark, SF_DIR)).select(*columns)
    assert decoded.exceptAll(grid).count() == 0 and grid.exceptAll(decoded).count() == 0


def test_long_codes_stay_as_written():
    assert wb._number_text("12345678901234567", False) == "12345678901234567"
    assert wb._number_text("5.0", False) == "5"
    assert wb._number_text("1.25", False) == "1.25"


def test_every_table_of_the_analysis_is_read_back(spark, folders, tmp_path):
    results = run_from_folders(spark, folders, str(tmp_path / "staged"))
    write_month_analysis(results, str(tmp_path / "out"))
    for name, df in results.items():
        if name == "daily_rollup":
            continue
        found = spark.read.parquet(str(tmp_path / "out" / name)).select(*df.columns)
        assert found.exceptAll(df).isEmpty() and df.exceptAll(found).isEmpty(), name


def test_load_rank_is_the_order_of_file_and_row(spark):
    rows_of_files = [(f"dir/{name}", row) for name in ("a", "b", "é", "ab", "") for row in (1, 5, 1_048_576)]
    many = spark.range(3000).select(F.concat(F.lit("n"), F.col("id") * 7919 % 3000).alias("src_file"), F.lit(2).alias("src_row"))
    snapshots = spark.createDataFrame(rows_of_files, "src_file string, src_row int").union(many).repartition(5)
    found = wb.with_load_rank(snapshots).collect()
    assert len(found) == 3015 and len({r.load_rank for r in found}) == 3015
    by_rank = [(r.src_file.encode(), r.src_row) for r in sorted(found, key=lambda r: r.load_rank)]
    assert by_rank == sorted(by_rank) and min(r.load_rank for r in found) >= 0
    assert wb.with_load_rank(snapshots.limit(0)).count() == 0


def test_stored_grids_of_some_warehouses_are_loaded(spark, tmp_path):
    grid = fx.grid(spark, SF_DIR)
    for name in ("WH-A", "WH-N"):
        grid.where(F.col("warehouse") == name).drop("warehouse").write.parquet(str(tmp_path / name))
    folders = {name: str(tmp_path / name) for name in ("WH-A", "WH-gone", "WH-N")}
    found = wb.load_snapshots(spark, folders, wb.scan_grids)
    expected = wb.snapshots_from_grid(grid.where(F.col("warehouse").isin("WH-A", "WH-N")))
    assert found.select(expected.columns).exceptAll(expected).isEmpty() and found.count() == expected.count()
    with pytest.raises(ValueError, match="no warehouse"):
        wb.load_snapshots(spark, {"WH-gone": str(tmp_path / "gone")}, wb.scan_grids)


def test_folders_of_many_warehouses_are_one_scan(spark, tmp_path):
    """Folders at two depths, one in another, one named twice, one by a pattern, with a column that only some have."""
    schema = "src_file string, src_row int, file_ts timestamp_ntz, a string, b string, c string, d string, e string, f string"
    stamp = day("2025-03-01")
    for k, name in enumerate(["x y", "x y/inner", "z%20", *[f"w{i}" for i in range(40)]]):
        one = spark.createDataFrame([(name, 5, stamp, None, "n", "1", "2", "m", f"c{k}")], schema)
        (one if k else one.withColumn("error", F.lit("none"))).write.mode("append").parquet(str(tmp_path / name))
    folders = {"A": "x y", "B": "x y/inner", "C": "z%20", "D": "z%20/", "E": "w1?", "F": "w1[12]", "gone": "gone", **{f"W{i}": f"w{i}" for i in range(40)}}
    found = wb.load_snapshots(spark, {name: f"{tmp_path}/{place}" for name, place in folders.items()}, wb.scan_grids)
    expected = [("A", "c0"), ("B", "c1"), ("C", "c2"), ("D", "c2"), ("F", "c14"), ("F", "c15")]
    expected += [("E", f"c{i + 13}") for i in range(10)] + [(f"W{i}", f"c{i + 3}") for i in range(40)]
    assert rows(found, "warehouse", "item_code") == sorted(expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 2  # the rows and the headers


def test_grids_are_stored_with_few_files_a_warehouse(spark, monkeypatch):
    """Not one from every task: each of 32 small warehouses has a single file."""
    seen = {}
    monkeypatch.setattr(wb, "load_snapshots", lambda _, folders, scan: seen.update(folders))
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").repartition(8)
    wide = lines.withColumn("l_suppkey", F.monotonically_increasing_id() % 320 * 5 + 3)
    tables = {"lineitem": wide, "part": spark.read.parquet(f"{SF_DIR}/part.parquet")}
    monkeypatch.setattr(fx, "table", lambda spark, d, name: tables[name])
    queries.load_snapshots(spark, SF_DIR)
    files = {name: len(glob.glob(f"{place.removeprefix('file:')}/*.parquet")) for name, place in seen.items()}
    assert len(files) == 33 and files.pop("WH-none") == 0 and set(files.values()) == {1}
