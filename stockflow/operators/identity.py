"""Item identities: conflicting codes, canonical names and name variants."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import DEFECT_MARKERS, name_changed, norm_code, norm_name
from .skew import salted_join
from .tables import require

NAME_KEYS = ("warehouse", "item_key")


def identity_conflicts(df: DataFrame, markers: Iterable[str] = DEFECT_MARKERS) -> DataFrame:
    """Name and code pairs whose normal name goes with more than one normal code.

    The table shrinks to its distinct pairs before anything else. Their row count keeps Spark
    from aggregating the smallest and largest code straight from the rows, so that both uses of
    the pairs share one pass and one shuffle. The normal name of a present name is never missing;
    saying so spares a null test of it on every row. More than one distinct code means that the smallest
    and the largest differ.
    """
    pairs = (
        require(df, ["item_name"])
        .groupBy("item_name", "item_code")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 0)
        .withColumns(
            {
                "item_code_norm": norm_code("item_code", drop="- "),
                "item_name_norm": F.coalesce(norm_name("item_name", markers), F.lit("")),
            }
        )
    )
    ambiguous = (
        pairs.groupBy("item_name_norm")
        .agg(F.min("item_code_norm").alias("_low"), F.max("item_code_norm").alias("_high"))
        .filter(F.col("_low") != F.col("_high"))
        .select("item_name_norm")
    )
    return pairs.join(ambiguous, "item_name_norm", "left_semi").select(
        "item_name", "item_code", "item_code_norm", "item_name_norm"
    )


def name_table(df: DataFrame, key: Sequence[str] = NAME_KEYS, rows: str | None = None) -> DataFrame:
    """Most frequent name per key, ties to the smallest.

    Rows are counted per name first, so a key contributes its distinct names, not its rows. ``rows``
    is a column that says how many rows each row stands for.
    """
    many = F.sum(rows) if rows else F.count(F.lit(1))
    counts = require(df, key).groupBy(*key, "item_name").agg(many.alias("_n"))
    rank = F.when(F.col("item_name").isNotNull(), F.struct(-F.col("_n"), F.col("item_name")))
    return counts.groupBy(*key).agg(
        F.coalesce(F.min_by("item_name", rank), F.lit("")).alias("canonical_name")
    )


def canonical_names(df: DataFrame, key: Sequence[str] = NAME_KEYS) -> DataFrame:
    """Add the canonical name and whether the row's name differs.

    The rows of a frequent key are salted, unless adaptive execution splits them.
    """
    return salted_join(df, name_table(df, key), key, adaptive=True).withColumn(
        "name_changed", name_changed("item_name", "canonical_name")
    )


def name_variants(df: DataFrame, key: Sequence[str] = NAME_KEYS) -> DataFrame:
    """The names of each key, a row for each."""
    return require(df, [*key, "item_name"]).select(*key, "item_name").distinct()


def variants_text(names: DataFrame, key: Sequence[str] = NAME_KEYS) -> DataFrame:
    """The names of each key as one text, for a report over chosen keys: it grows with a key's names."""
    joined = F.array_join(F.array_sort(F.collect_set("item_name")), ", ")
    return names.groupBy(*key).agg(joined.alias("name_variants"))
