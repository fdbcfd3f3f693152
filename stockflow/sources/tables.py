"""Readers of derived tables and writers of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import month_start, parse_dt
from ..functions.numbers import to_flag, to_number
from ..functions.text import strip_ws
from ..operators.tables import conform, nan_as_null, rename
from ..schema import ENRICHED_DAILY, HEADINGS, MONTHLY_ALIASES, MONTHLY_DEFAULTS
from ..session import fresh_path

#: What Spark calls a path that does not exist.
MISSING_PATH = "PATH_NOT_FOUND"


def is_missing(error: AnalysisException) -> bool:
    """Whether a read failed because nothing is there; any other failure must be seen."""
    return error.getCondition() == MISSING_PATH


def _read(
    spark: SparkSession, path: str, fmt: str, aliases: Mapping[str, str] | None = None
) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return rename(rename(reader.load(path), aliases or {}), HEADINGS)


def _read_if_there(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    try:
        return _read(spark, path, fmt)
    except AnalysisException as error:
        if is_missing(error):
            return None
        raise


def _cast_to(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order; absent ones are missing, unreadable values too."""
    columns = []
    for field in schema.replace("\n", " ").split(","):
        name, kind = field.split()
        value = F.col(name) if name in df.columns else F.lit(None)
        columns.append(value.try_cast(kind).alias(name))
    return df.select(*columns)


def read_table_or_empty(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet"
) -> DataFrame:
    """A table with a fixed schema; empty when its path does not exist. Other failures are raised."""
    found = _read_if_there(spark, path, fmt)
    return spark.createDataFrame([], schema) if found is None else _cast_to(found, schema)


def read_spikes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The spike table, which must exist: its date parsed and its flag boolean."""
    spikes = _read(spark, path, fmt)
    if "month_start" not in spikes.columns and "dt" in spikes.columns:
        spikes = spikes.withColumnRenamed("dt", "month_start")
    return spikes.withColumns(
        {
            "month_start": F.col("month_start").try_cast("date"),
            "is_spike": to_flag("is_spike"),
        }
    )


def clean_enriched_daily(df: DataFrame) -> DataFrame:
    """Strip codes and names, coerce dates and numbers, and mark nothing as anomalous by default."""
    kinds = dict(df.dtypes)
    changes = {c: strip_ws(c) for c in ("item_code", "item_name") if c in kinds}
    if "dt" in kinds:
        changes["dt"] = parse_dt("dt")
    for c in ("stock", "price"):
        if c in kinds:
            changes[c] = to_number(c) if kinds[c] == "string" else F.col(c).cast("double")
    return nan_as_null(conform(df.withColumns(changes), {"is_anomaly": ("boolean", False)}))


def read_enriched_daily(spark: SparkSession, path: str) -> DataFrame:
    """The enriched daily table, cleaned; empty when its path does not exist. Other failures are raised."""
    found = _read_if_there(spark, path, "parquet")
    return spark.createDataFrame([], ENRICHED_DAILY) if found is None else clean_enriched_daily(found)


def load_monthly(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The monthly table with unified headings, its absent measures and a month-start date."""
    monthly = conform(_read(spark, path, fmt, MONTHLY_ALIASES), MONTHLY_DEFAULTS)
    kinds = {"year": "int", "month": "int", **{c: k for c, (k, _) in MONTHLY_DEFAULTS.items()}}
    return monthly.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}).withColumn(
        "month_start", month_start("year", "month")
    )


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    """Write a result, replacing an earlier one.

    A partitioned table is rebalanced first: one task does not write a file into every folder,
    and a folder that holds much is still written by several tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").format(fmt).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


#: Tells spreadsheets that a file is UTF-8; Spark's readers skip it.
BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ("dt", "warehouse", "item_code")) -> None:
    """Write an ordered CSV in UTF-8. Each file starts with its heading, and the heading with a byte order mark."""
    marked = df.orderBy(*order).withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])
    marked.write.mode("overwrite").option("header", True).csv(path)


def write_partitions(df: DataFrame, path: str, partition_by: Sequence[str] = ("year", "month")) -> None:
    """Replace the partitions that the frame has rows for, and leave the others as they are."""
    writer = df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def store_by_key(
    df: DataFrame, name: str, path: str, buckets: int, key: str = "item_key", order: Sequence[str] = ("warehouse", "dt")
) -> DataFrame:
    """A stored table for look-ups: bucketed by a key and sorted by it within each file.

    A look-up of a key reads one bucket, and of that only the row groups that may hold the key; a join or an
    aggregate by the key does not shuffle the table. ``name`` is its name in the catalogue, by which it is found
    again. The rows are brought to their buckets first, so that a bucket is one file.
    """
    placed = df.repartition(buckets, key).sortWithinPartitions(key, *order)
    writer = placed.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, *order)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a result that several others need, below the folder or the shared one, and read it back.

    Lost executors then cost the tasks they ran, not the whole lineage.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{name}" if folder else fresh_path(spark, name)
    df.write.mode("overwrite" if folder else "errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
