"""Daily stock workbooks: a folder of spreadsheets per warehouse.

Spark lists and reads the files and hands each workbook to a task, which only turns the
cells of its active sheet into rows. Everything after that is DataFrame work.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import as_of_source, parse_as_of, resolve_as_of
from ..functions.numbers import to_number
from ..functions.text import strip_ws

CELLS = "a string, b string, c string, d string, e string, f string"
DECODED = f"src_file string, file_ts timestamp_ntz, as_of_cell string, src_row int, {CELLS}, error string"
LETTERS = "abcdef"

# Where the date and the item lines stand in a sheet.
DATE_ROW = 2
FIRST_ITEM_ROW = 5

_BATCH = 20_000
_EPOCH = dt.datetime(1899, 12, 30)
_CELL = re.compile(r"([A-Z]+)(\d+)")
# Number format ids that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in node.iter() if _local(e.tag) == name)


def _active_sheet(book: zipfile.ZipFile) -> str:
    tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = list(_all(tree, "sheet"))
    view = next(_all(tree, "workbookView"), None)
    active = int(view.get("activeTab", "0")) if view is not None else 0
    link = next(v for k, v in sheets[active].attrib.items() if _local(k) == "id")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in _all(links, "Relationship") if r.get("Id") == link)
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    tree = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_rich_text(item) for item in _all(tree, "si")]


def _rich_text(node: ElementTree.Element) -> str:
    """Text of a string item, phonetic hints left out."""
    runs = []
    for child in node:
        if _local(child.tag) == "t":
            runs.append(child.text or "")
        elif _local(child.tag) == "r":
            runs.extend(t.text or "" for t in _all(child, "t"))
    return "".join(runs)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    tree = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for fmt in _all(tree, "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search(r"[dmyhs]", code, re.IGNORECASE):
            dates.add(int(fmt.get("numFmtId")))
    styles = next(_all(tree, "cellXfs"), [])
    return {i for i, xf in enumerate(styles) if int(xf.get("numFmtId", "0")) in dates}


def _number_text(text: str, is_date: bool) -> str:
    if is_date:
        return (_EPOCH + dt.timedelta(days=float(text))).isoformat(sep=" ", timespec="seconds")
    if re.fullmatch(r"-?\d+", text):  # a code of any length stays as written
        return text
    number = float(text)
    return str(int(number)) if number.is_integer() else repr(number)


def _cell_text(cell: ElementTree.Element, strings: Sequence[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = next((c for c in cell if _local(c.tag) == "is"), None)
        return _rich_text(inline) if inline is not None else None
    text = next((c.text for c in cell if _local(c.tag) == "v"), None)
    if text is None:
        return None
    if kind == "s":
        return strings[int(text)]
    if kind == "n":
        return _number_text(text, int(cell.get("s", "0")) in dates)
    return text


def sheet_rows(content: bytes) -> Iterator[tuple[int, dict[str, str | None]]]:
    """Row number and the texts of columns A to F, for each row of the active sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates = _shared_strings(book), _date_styles(book)
        number = 0
        with book.open(_active_sheet(book)) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if _local(node.tag) != "row":
                    continue
                number = int(node.get("r", number + 1))
                cells, column = {}, 0
                for cell in node:
                    place = _CELL.match(cell.get("r", ""))
                    letter = place[1].lower() if place else LETTERS[column : column + 1]
                    if letter and letter in LETTERS:
                        cells[letter] = _cell_text(cell, strings, dates)
                        column = LETTERS.index(letter) + 1
                    else:
                        column = len(LETTERS)
                yield number, cells
                node.clear()


def _decode_file(path: str, content: bytes) -> dict[str, list]:
    """Columns of one workbook: its date row and item rows, or its error as a single row.

    A sheet holds at most 1,048,576 rows, which bounds what a task keeps. Nothing is given out
    before the whole file is read, so a file that breaks off midway yields its error only.
    """
    columns = {name: [] for name in ("src_row", *LETTERS)}

    def add(number: int | None, cells: Mapping[str, str | None]) -> None:
        columns["src_row"].append(number)
        for letter in LETTERS:
            columns[letter].append(cells.get(letter))

    extension = posixpath.splitext(path)[1].lower()
    error, header = None, {}
    if extension != ".xlsx":
        error = f"unsupported {extension}"
    else:
        try:
            for number, cells in sheet_rows(content):
                if number == DATE_ROW:
                    header = cells
                elif number >= FIRST_ITEM_ROW:
                    add(number, cells)
        except Exception as failure:  # one broken file must not stop the others
            error = f"{type(failure).__name__}: {failure}"
            columns = {name: [] for name in columns}
    add(None if error else DATE_ROW, header)
    size = len(columns["src_row"])
    return {**columns, "as_of_cell": [header.get("a")] * size, "error": [error] * size}


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("src_file", pa.string()), ("file_ts", pa.timestamp("us")), ("as_of_cell", pa.string())]
        + [("src_row", pa.int32())]
        + [(name, pa.string()) for name in (*LETTERS, "error")]
    )
    for files in batches:
        pending = {name: [] for name in schema.names}
        for file in files.to_pylist():
            sheet = _decode_file(file["path"], file["content"])
            size = len(sheet["src_row"])
            sheet |= {"src_file": [file["path"]] * size, "file_ts": [file["file_ts"]] * size}
            for name, values in sheet.items():
                pending[name].extend(values)
            if len(pending["src_row"]) >= _BATCH:
                yield from pa.Table.from_pydict(pending, schema).to_batches(_BATCH)
                pending = {name: [] for name in schema.names}
        yield from pa.Table.from_pydict(pending, schema).to_batches(_BATCH)


#: Bits of a load rank for the row within its sheet, which has at most 2 ** 20, counted from 1.
ROW_BITS = 21
#: Ranges of file names that are numbered independently of each other.
FILE_RANGES = 256


def decode_workbooks(files: DataFrame) -> DataFrame:
    """Cell grid of files as the ``binaryFile`` source gives them, the date cell on every row."""
    return files.select(
        "path", F.col("modificationTime").cast("timestamp_ntz").alias("file_ts"), "content"
    ).mapInArrow(_decode, DECODED)


#: Where a row was read from, until its warehouse is known: as Spark shows a path, or as an address with escapes.
_PATH, _ADDRESS = "_path", "_address"


def scan_workbooks(spark: SparkSession, path: str | Sequence[str], warehouse: str | None = None) -> DataFrame:
    """Cell grid of every workbook in a folder, tagged with its warehouse; of several folders, with their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls*").load(path)
    grid = decode_workbooks(files)
    return grid.withColumn(_PATH, F.col("src_file")) if warehouse is None else grid.withColumn("warehouse", F.lit(warehouse))


def _dated(grid: DataFrame) -> DataFrame:
    """The grid with the as-of time of each row's file.

    Decoded grids carry the date cell on every row. For others the headers, one short row per
    file, are joined by file: broadcast while they are small, otherwise split by Spark where a
    file holds many rows.
    """
    if "as_of_cell" in grid.columns:
        return grid.withColumn("dt", resolve_as_of("as_of_cell", "file_ts"))
    cells = grid.filter(F.col("src_row") == DATE_ROW).groupBy("src_file").agg(F.max("a").alias("_cell"))
    headers = cells.select("src_file", parse_as_of("_cell").alias("_as_of"))
    return grid.join(headers, "src_file", "left").withColumn("dt", F.coalesce("_as_of", "file_ts"))


def _code_text(cell: Column | str) -> Column:
    """Code of a cell; a whole number loses its empty fraction."""
    return F.regexp_replace(strip_ws(cell), r"^(\d+)\.0$", "$1")


def _quantity(cell: str) -> Column:
    """Number of a cell; a blank one counts as zero, an unreadable one is missing."""
    blank = F.length(F.coalesce(strip_ws(cell), F.lit(""))) == 0
    return F.when(blank, F.lit(0.0)).otherwise(to_number(cell))


def _is_item() -> Column:
    return (F.col("src_row") >= FIRST_ITEM_ROW) & F.col("f").isNotNull()


def snapshots_from_grid(grid: DataFrame) -> DataFrame:
    """Snapshot rows of a cell grid: item lines with a code, dated by their file."""
    return (
        _dated(grid)
        .filter(_is_item())
        .select(
            "dt",
            F.col("b").alias("item_name"),
            _quantity("c").alias("stock"),
            _quantity("d").alias("price"),
            F.col("e").alias("manufacturer"),
            _code_text("f").alias("item_code"),
            "warehouse",
            "src_file",
            "src_row",
        )
    )


def ingest_audit(grid: DataFrame) -> DataFrame:
    """Outcome per file: item lines read, where its date came from, and its error."""
    error = F.max("error") if "error" in grid.columns else F.lit(None).cast("string")
    per_file = grid.groupBy("warehouse", "src_file").agg(
        F.count_if(_is_item()).alias("item_lines"),
        F.max(F.when(F.col("src_row") == DATE_ROW, F.col("a"))).alias("_cell"),
        error.alias("error"),
    )
    return per_file.select(
        "warehouse",
        "src_file",
        "item_lines",
        F.when(F.col("error").isNull(), as_of_source("_cell")).alias("date_source"),
        "error",
    )


def scan_grids(spark: SparkSession, path: str | Sequence[str], warehouse: str | None = None) -> DataFrame:
    """Cell grid that was stored as Parquet, tagged with its warehouse; of several folders, with their addresses.

    A column that only some folders have is missing in the others.
    """
    paths = [path] if isinstance(path, str) else path
    grid = spark.read.option("mergeSchema", True).parquet(*paths)
    if warehouse is None:
        return grid.withColumn(_ADDRESS, F.col("_metadata.file_path"))
    return grid.withColumn("warehouse", F.lit(warehouse))


def load_snapshots(
    spark: SparkSession,
    folders: Mapping[str, str],
    scan: Callable[[SparkSession, list[str]], DataFrame] = scan_workbooks,
) -> DataFrame:
    """Snapshot rows of several warehouses; a missing folder is skipped, all missing is an error.

    ``scan`` reads folders: of workbooks, or with ``scan_grids`` of grids decoded before. All folders are one scan, so
    the plan does not grow with the warehouses.
    """
    found = _folders(spark, folders)
    if not found:
        raise ValueError("no warehouse folder could be read")
    # Found paths are names, no patterns.
    paths = [re.sub(r"([][{}*?\\])", r"\\\1", path) for path in dict.fromkeys(path for _, path, _ in found)]
    return snapshots_from_grid(_with_warehouse(scan(spark, paths), found))


def _folders(spark: SparkSession, folders: Mapping[str, str]) -> list[tuple[str, str, str]]:
    """Warehouse, path and address of the folders that are there; a path may be a pattern of several."""
    found, conf = [], spark._jsc.hadoopConfiguration()
    for warehouse, folder in folders.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(conf)
        for status in files.globStatus(files.makeQualified(path)) or []:
            found.append((warehouse, status.getPath().toString(), status.getPath().toUri().toString()))
    return list(dict.fromkeys(found))


def _plain(path: str) -> str:
    """A path with one slash for an authority that is left out, which is written as one or as three."""
    return re.sub(r"^([^:/]+):///", r"\1:/", path)


def _with_warehouse(grid: DataFrame, found: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The grid with the warehouse whose folder each row was read from, the innermost one if folders lie in another.

    The list of folders is what the caller holds, and is broadcast. A folder that two warehouses name gives rows of both.
    """
    at = _PATH if _PATH in grid.columns else _ADDRESS
    places = [(warehouse, _plain(path if at == _PATH else address)) for warehouse, path, address in found]
    grid = grid.drop("warehouse").withColumn(at, F.regexp_replace(at, "^([^:/]+):///", "$1:/"))
    known, depths = F.lit(None).cast("string"), {place.count("/") + 1 for _, place in places}
    for depth in sorted(depths, reverse=True):
        listed = zip(*[(w, place) for w, place in places if place.count("/") + 1 == depth])
        names = grid.sparkSession.createDataFrame(pa.table([pa.array(c, pa.string()) for c in listed], [f"_at_{depth}", "_folder"]))
        same = known.isNull() & (F.substring_index(at, "/", depth) == F.col("_folder"))
        grid = grid.join(F.broadcast(names), same, "left").drop("_folder")
        known = F.coalesce(known, f"_at_{depth}")
    return grid.withColumn("warehouse", known).drop(at, *[f"_at_{depth}" for depth in depths])


def with_load_rank(snapshots: DataFrame) -> DataFrame:
    """Add the load order, by file and row, as one number; first values by it need no sort.

    Files are numbered by name, in ranges, so that no task sees them all. The number has ``ROW_BITS`` bits for the
    row, 33 for the file within its range, and the rest for the range.
    """
    names = snapshots.select("src_file").distinct()
    names = names.repartitionByRange(FILE_RANGES, "src_file").sortWithinPartitions("src_file")
    ordinals = names.withColumn("_file", F.monotonically_increasing_id())
    rank = F.shiftleft("_file", ROW_BITS).bitwiseOR(F.col("src_row").cast("bigint"))
    return snapshots.join(ordinals, "src_file", "left").withColumn("load_rank", rank).drop("_file")
