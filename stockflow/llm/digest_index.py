"""Exact deduplication against a persistent index of digests.

The index is a Parquet table, bucketed and sorted by the SHA-256 digest of the text. New data is brought to one row
per digest. A sort-merge anti-join with the index finds the digests that it does not hold; they are appended as
new texts, and the others as further rows of texts it knows, so nothing written is ever changed. Read by digest,
the rows of a text give its largest id and its number of documents, whatever the order of the loads.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.skew import salted_join
from .common import fresh_path, id_key, known, staged, unused


class DigestIndex:
    """An index at a path that all executors share; reopened by giving the same path and number of buckets.

    A load has a name. Repeating a load, as after it broke off, counts once if it has the same name.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.path = path or fresh_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        location = self.path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, is_new BOOLEAN, load STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        """What was appended: a row for each digest of each load."""
        return self.spark.table(self.name)

    def entries(self) -> DataFrame:
        """(digest, keep_id, group_size) of each text: its largest id and its documents, over all loads.

        The table is placed by digest, so no row is shuffled for it.
        """
        once = self.rows().groupBy("digest", "load").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        return once.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def new_groups(self, groups: DataFrame) -> DataFrame:
        """Those of some groups by digest whose text the index does not hold: a sort-merge anti-join, in the index's buckets."""
        return groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def add(self, docs: DataFrame, load: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Index the documents of a load; null texts count as empty. An empty load adds nothing."""
        self.add_digests(digests(docs, id_col, text_col), load)

    def add_digests(self, rows: DataFrame, load: str | None = None) -> None:
        """Index rows (id, digest).

        Groups are written before they meet the index, for both joins read them.
        """
        groups = rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        groups = staged(groups, "groups")
        held = self.rows().select("digest").distinct()
        parts = [
            self.new_groups(groups).withColumn("is_new", F.lit(True)),
            groups.hint("merge").join(held, "digest", "left_semi").withColumn("is_new", F.lit(False)),
        ]
        found = parts[0].unionByName(parts[1]).withColumn("load", F.lit(load or uuid.uuid4().hex))
        found = found.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        found.select("digest", "keep_id", "group_size", "is_new", "load").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def forget(self) -> None:
        """Take the index out of the catalogue; its files stay, and it can be opened by its path again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(id, digest) of every row, and further columns; a null text counts as empty."""
    text = known(F.col(text_col))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), *more)


def verdicts(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row (id, digest): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id of all loads stays. Repeated rows (same id and text) get the same verdict each. A
    null id stays only where a group has no other. Of an empty frame nothing is returned. The rows of a digest that
    holds a large part of them are dealt over many tasks.
    """
    found = salted_join(rows, index.entries(), ["digest"], "inner")
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(
    docs: DataFrame,
    index: DigestIndex | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    loads: Sequence[Column] = (),
) -> DataFrame:
    """Index all rows of a frame and return their verdicts, as of the end of the last load.

    ``loads`` are conditions: the rows for which the first is true are loaded first, and so on; the other rows are
    the last load. Null texts count as empty.
    """
    index = index or DigestIndex(docs.sparkSession)
    number = F.lit(len(loads))
    for i, condition in reversed(list(enumerate(loads))):
        number = F.when(condition, i).otherwise(number)
    rows = digests(docs, id_col, text_col, number.alias("load"))
    rows = staged(rows, "digests")
    for i in range(len(loads) + 1):
        index.add_digests(rows.where(F.col("load") == i).drop("load"))
    return verdicts(rows.drop("load"), index)


def unique_rows(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; exactly one of each distinct text.

    Rows meet the index by digest and id together, so a hot group is spread over all tasks by its ids.
    Of rows repeated with the same id and text, one stays. Null texts count as empty; of an empty frame nothing is
    returned.
    """
    index = index or DigestIndex(docs.sparkSession)
    index.add(docs, None, id_col, text_col)
    digest, key = unused(docs, "digest", "id_key")
    rows = docs.withColumn(digest, F.unhex(F.sha2(known(F.col(text_col)), 256))).withColumn(key, id_key(id_col))
    kept = index.entries().select(F.col("digest").alias(digest), id_key("keep_id").alias(key))
    return rows.join(kept, [digest, key], "left_semi").dropDuplicates([digest, key]).select(*docs.columns)
