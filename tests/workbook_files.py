"""Workbook files made from grid rows."""

from __future__ import annotations

import io
import sys
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from stockflow import fixtures as fx

# The parts of a minimal workbook.
_CONTENT_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="xml" ContentType="application/xml"/></Types>'
)
_WORKBOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>'
)
_RELATIONS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
)
_SHEET = (
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    "<sheetData>{}</sheetData></worksheet>"
)


def _cell(letter: str, row: int, value: str | None) -> str:
    if value is None:
        return ""
    if letter in "cd":
        return f'<c r="{letter.upper()}{row}"><v>{value}</v></c>'
    text = f'<is><t xml:space="preserve">{escape(value)}</t></is>'
    return f'<c r="{letter.upper()}{row}" t="inlineStr">{text}</c>'


def encode_workbook(rows: list[dict]) -> bytes:
    """Workbook bytes of one file's grid rows."""
    lines = []
    for row in sorted(rows, key=lambda r: r["src_row"]):
        cells = "".join(_cell(c, row["src_row"], row[c]) for c in "abcdef")
        lines.append(f'<row r="{row["src_row"]}">{cells}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _CONTENT_TYPES)
        book.writestr("xl/workbook.xml", _WORKBOOK)
        book.writestr("xl/_rels/workbook.xml.rels", _RELATIONS)
        book.writestr("xl/worksheets/sheet1.xml", _SHEET.format("".join(lines)))
    return out.getvalue()


def _encode_group(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    return pa.table(
        {
            "path": pa.array([rows[0]["src_file"]]),
            "modificationTime": pa.array([rows[0]["file_ts"]], pa.timestamp("us")),
            "content": pa.array([encode_workbook(rows)], pa.binary()),
        }
    )


def workbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as files, shaped as the ``binaryFile`` source gives them.

    The number of partitions is explicit because a few bytes here are a lot of work.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        fx.grid(spark, sf_dir)
        .repartition(partitions, "src_file")
        .groupBy("src_file")
        .applyInArrow(_encode_group, "path string, modificationTime timestamp_ntz, content binary")
    )


# Workers do not see this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
