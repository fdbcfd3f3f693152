"""Row windows over series of any length.

A window over a whole series puts the series into one task. That is right for nearly all series, so the frequent
keys are found first, with a sketch of bounded size. Only their series are cut, into slices of time whose number
grows with their share of the rows, and each slice is given copies of the rows just before it, its halo. A window
per slice then sees every row it would have seen in the whole series.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

IS_HALO = "_is_halo"
SLICE = "_slice"
#: Shares of a task: a key is frequent if it holds more rows than one share of one task. Slices hold about as many.
SHARES = 4


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shares(spark: SparkSession) -> int:
    return SHARES * tasks(spark)


def placed(df: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt by hash to as many tasks as the session shuffles to.

    Several sorts and aggregates follow on one placement, and a task holds its rows in each of them, which comes to
    about 25 times their size in the shuffle. Adaptive execution would put tasks together up to its target for the
    shuffle, whatever follows; with a stated number it does not.
    """
    return df.repartition(tasks(df.sparkSession), *columns)


def frequent(df: DataFrame, column: str) -> dict:
    """The values of a column with more than one of ``shares`` of the rows, and how many shares each has, at least 2.

    All of them together have about as many shares as there are, so their number is bounded.

    It takes one pass with a sketch, whose size depends on the number of shares alone. It may leave a value out that is
    just above the bound or name one just below, which costs time and changes no result.
    """
    most = shares(df.sparkSession)
    top = F.expr(f"approx_top_k({column}, {most}, {min(16 * most, 1_000_000)})").alias("top")
    found = df.where(F.col(column).isNotNull()).agg(top, F.count(column).alias("n")).first()
    return {x["item"]: -(-x["count"] * most // found["n"]) for x in found["top"] or [] if x["count"] * most > found["n"]}


def literal_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A table of a few rows that the driver knows, as part of the plan."""
    values = json.dumps([dict(zip(schema.names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(values), ArrayType(schema))))


def _seconds(df: DataFrame, time: str) -> Column:
    """A time as whole seconds that never decrease with it, whatever the session's time zone."""
    if dict(df.dtypes)[time] == "timestamp":
        return F.col(time).cast("bigint")
    at = F.col(time).cast("timestamp_ntz")
    in_day = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.datediff(at, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400 + in_day


def with_slices(df: DataFrame, column: str, time: str, hot: dict, measured: DataFrame) -> DataFrame:
    """Add the slice of time of each row of a frequent key; it is null for the rows of other keys.

    A key's slices are equally long parts of its time in the measured frame, one for each share of the rows that
    it holds. They are joined from a table with a row for each frequent key, whose number ``shares`` bounds.
    """
    spark = df.sparkSession
    keys = literal_table(spark, [(k,) for k in hot], df.select(column).schema)
    at = _seconds(measured, time)
    spans = measured.join(F.broadcast(keys), column, "left_semi").groupBy(column).agg(F.min(at), F.max(at)).collect()
    rows = [(k, low, max(1.0, (high - low + 1) / hot[k])) for k, low, high in spans if low is not None]
    schema = StructType([df.schema[column], StructField("_from", LongType()), StructField("_length", DoubleType())])
    table = F.broadcast(literal_table(spark, rows, schema))
    place = F.floor((_seconds(df, time) - F.col("_from")) / F.col("_length"))
    return df.join(table, column, "left").withColumn(SLICE, place).drop("_from", "_length")


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    segment: Sequence[str],
    order: Sequence[str],
    lookback: int = 1,
    place: Sequence[str] | None = None,
    several: Column | None = None,
) -> DataFrame:
    """Add to each segment the ``lookback`` rows that precede it in its series.

    ``segment`` must not decrease along ``order``, and ``order`` must be unique per series.
    The rows are placed by hash of ``place``, a subset of keys and segment that later stages
    share, so that windows and aggregates on it need no further shuffle. Both branches read
    the same exchange. Only the last rows of each segment travel by series: ``lookback`` per
    segment, whatever the number of rows in it. ``several`` says for which rows the series has more
    than one segment; series of one need no halo.
    """
    place = list(place or [*keys, *segment])
    rows = placed(df, *place)

    latest_first = Window.partitionBy(*keys, *segment).orderBy(*[F.desc(c) for c in order])
    back = F.row_number().over(latest_first)
    tails = (
        # As part of the window's result, the condition reaches neither branch of the exchange.
        rows.withColumn("_back", back if several is None else F.when(several, back))
        .filter(F.col("_back") <= lookback)
        .drop("_back")
    )

    along = Window.partitionBy(*keys).orderBy(*order)
    own = F.struct(*segment)
    following = F.array_distinct(F.array(*[F.lead(own, i).over(along) for i in range(1, lookback + 1)]))
    halo = (
        tails.withColumn("_to", following)
        .withColumn("_to", F.explode("_to"))
        .filter(F.col("_to").isNotNull() & (F.col("_to") != own))
        .withColumns({c: F.col(f"_to.{c}") for c in segment})
        .drop("_to")
    )
    return rows.withColumn(IS_HALO, F.lit(False)).unionByName(placed(halo, *place).withColumn(IS_HALO, F.lit(True)))


def hashed(*keys: Column | str) -> list[Column | str]:
    """The keys led by their hash, to partition a window by: its sort then seldom compares their texts."""
    return [F.xxhash64(*keys), *keys]


def segment_window(keys: Sequence[str], segment: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Window of one segment with its halo in front."""
    return Window.partitionBy(*hashed(*keys, *segment)).orderBy(*order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(IS_HALO)).drop(IS_HALO)


def step(column: Column | str, window: WindowSpec) -> Column:
    """Difference to the previous row of the window."""
    return F.col(column) - F.lag(column).over(window)
