"""What the operators of this package share: input, text helpers and the shared folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path

#: White space that separates words, and blanks of the same number.
WHITE = "\t\n\x0b\x0c\r"
BLANKS = " " * len(WHITE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known(text: Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(text, F.lit(""))


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in parts])


def words(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space."""
    text = known(text)
    # Replacing one character is much cheaper than translating, and most texts have no other than line ends.
    plain = F.when(contains_any(text, WHITE.replace("\n", "")), F.translate(text, WHITE, BLANKS))
    plain = plain.otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(plain, " "), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a text are among the given ones."""
    removed = F.length(text) - F.length(F.translate(text, characters, ""))
    return F.when(contains_any(text, characters), removed).otherwise(0)


def id_key(name: str) -> Column:
    """The id as text, never null, so that rows can be joined and made unique by it in one shuffle."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names as asked for, changed until they clash with none of the frame."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame written once as Parquet in the run's part of the shared folder and read again.

    It cuts the lineage like a checkpoint, and its files tell Spark the frame's size.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def each_row(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, str]]:
    """(id, text) of batches with these two columns, one text at a time, null texts as empty."""
    for batch in batches:
        ids, texts = batch.columns
        for key, text in zip(ids, texts, strict=True):
            yield key.as_py(), text.as_py() or ""


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded number of rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)


def per_text(df: DataFrame, id_col: str, text_col: str, function, fields: dict[str, pa.DataType]) -> DataFrame:
    """A frame of (id, *fields): ``function`` gets (id, text) pairs and gives rows, partition by partition.

    Other columns of the frame are not read, so their names cannot clash.
    """
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    frame = df.select(id_col, text_col)
    schema = pa.schema([to_arrow_schema(frame.select(id_col).schema).field(0), *map(pa.field, fields, fields.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(function(each_row(batches)), schema)

    return frame.mapInArrow(run, from_arrow_schema(schema))
