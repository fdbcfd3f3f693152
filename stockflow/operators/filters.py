"""Row selection by warehouse, item, name and flag."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def to_list(value: object) -> list:
    """A scalar, a collection or nothing, as a list."""
    if value is None:
        return []
    if isinstance(value, (list, tuple, set, frozenset)):
        return list(value)
    return [value]


def in_warehouses(df: DataFrame, warehouses: Iterable[str] | str | None, empty: str = "all") -> DataFrame:
    """Rows of the chosen warehouses; no choice keeps ``all`` rows or ``none``."""
    if empty not in ("all", "none"):
        raise ValueError("empty must be 'all' or 'none'")
    chosen = to_list(warehouses)
    if chosen:
        return df.filter(F.col("warehouse").isin(chosen))
    return df if empty == "all" else df.limit(0)


def select_items(
    df: DataFrame,
    warehouse: str | None = None,
    item: str | None = None,
    name: str | None = None,
    item_column: str = "item_code",
    name_column: str = "item_name",
    require_any: bool = False,
) -> DataFrame:
    """Rows that equal every given value; ``require_any`` wants an item or a name."""
    if require_any and not item and not name:
        return df.limit(0)
    if warehouse:
        df = df.filter(F.col("warehouse") == warehouse)
    if item:
        df = df.filter(F.col(item_column).cast("string") == str(item))
    if name:
        df = df.filter(F.col(name_column) == name)
    return df


def without_anomalies(df: DataFrame) -> DataFrame:
    """Rows not marked as anomalous; a table without the mark has none."""
    if "is_anomaly" not in df.columns:
        return df.withColumn("is_anomaly", F.lit(False))
    return df.filter(~F.coalesce(F.col("is_anomaly"), F.lit(False)))


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct present values of a column in order."""
    return df.select(column).na.drop().distinct().orderBy(column)
