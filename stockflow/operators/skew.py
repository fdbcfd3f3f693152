"""Joins in which some keys hold far more rows than a task should."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .halo import frequent, literal_table, shares

_KEY, _SALT, _HOT = "_key_hash", "_salt", "_hot"
_MARKS = StructType([StructField(_KEY, LongType()), StructField(_HOT, BooleanType())])


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def splits_skew(spark: SparkSession) -> bool:
    """Whether adaptive execution splits the large partitions of joins in this session."""
    return all(spark.conf.get(f"spark.sql.adaptive.{c}", "true") == "true" for c in ("enabled", "skewJoin.enabled"))


def salted_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", adaptive: bool = False
) -> DataFrame:
    """Join rows with a table that has few rows for each key, also where a key holds a large part of the rows.

    The frequent keys of the rows are found by a sketch of bounded size. Their rows are dealt by a hash of the whole
    row to as many salts as there are shares of a task, and their rows of the table are copied to each salt. Nothing else
    is copied, and nothing depends on what adaptive execution finds at run time. Null keys match nothing, as in any
    join. Counting the keys reads the rows once more; with ``adaptive`` that is left out, and the join left plain,
    where adaptive execution splits skewed joins itself.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"a salted join is left or inner, not {how}")
    if adaptive and splits_skew(rows.sparkSession):
        return rows.join(table, list(keys), how)
    hot = frequent(rows.select(_hash(keys).alias(_KEY)), _KEY)
    if not hot:
        return rows.join(table, list(keys), how)
    spark, n = rows.sparkSession, shares(rows.sparkSession)
    marks = F.broadcast(literal_table(spark, [(k, True) for k in hot], _MARKS))
    own = rows.withColumn(_KEY, _hash(keys)).join(marks, _KEY, "left")
    deal = F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(n)).cast("int")
    own = own.withColumn(_SALT, F.when(F.col(_HOT), deal).otherwise(0)).drop(_KEY, _HOT)
    copies = F.when(F.col(_HOT), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    other = table.withColumn(_KEY, _hash(keys)).join(marks, _KEY, "left").withColumn(_SALT, F.explode(copies))
    return own.join(other.drop(_KEY, _HOT), [*keys, _SALT], how).drop(_SALT)
