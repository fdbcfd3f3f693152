"""Shaping of whole tables: missing columns, names, missing values, appending."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import nan_to_null
from ..functions.text import norm_code, strip_ws


def conform(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add the columns the table lacks, each with its type and default."""
    absent = {
        name: F.lit(value).cast(kind)
        for name, (kind, value) in defaults.items()
        if name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns found in the map."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace missing values, column by column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows that miss any of the columns; grouping keys go through here."""
    return df.filter(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def union_all(frames: Iterable[DataFrame | None]) -> DataFrame | None:
    """Append tables by column name and keep duplicates; absent tables are skipped."""
    present = [df for df in frames if df is not None]
    if not present:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def nan_as_null(df: DataFrame) -> DataFrame:
    """Turn not-a-number into missing in every floating column."""
    floating = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in floating}) if floating else df


def clean_snapshots(df: DataFrame) -> DataFrame:
    """Snapshot rows ready for analysis: a code in normal form, a timestamp, no not-a-number."""
    cleaned = require(df, ["item_code"]).withColumn("item_code", norm_code(strip_ws("item_code")))
    kind = dict(df.dtypes)["dt"]
    if kind != "timestamp_ntz":
        cleaned = cleaned.withColumn("dt", F.col("dt").try_cast("timestamp_ntz"))
    return nan_as_null(cleaned)
